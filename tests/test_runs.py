import numpy as np
import pytest

from twinframe.params import Params
from twinframe.plans import runs
from twinframe.sources import cache
from twinframe.sources.decode import ArrayMedia, hash_media
from twinframe.sources.listing import cache_path, list_media

P = Params(4, 8, 90.0, 20)


def media(path, seed, n=600, fps=25.0, broken=None, noise=0.0):
    rng = np.random.default_rng(seed)
    frames = rng.normal(size=(n, 8, 8)) + noise * np.random.default_rng(99).normal(size=(n, 8, 8))
    if broken is not None:
        frames[broken] = np.nan
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as f:
        np.savez(f, frames=frames, fps=fps)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    media(d / "a.mp4", 1)
    media(d / "b.MKV", 1, noise=0.01)
    media(d / "c.avi", 2)
    media(d / "short.mov", 3, n=100)
    media(d / "cut.flv", 4, broken=-1)
    media(d / "sub" / "d.wmv", 5)
    media(d / "watched_videos" / "e.mp4", 1)
    (d / "notes.txt").write_text("x")
    (d / "bad.mp4").write_text("x")
    return d


def test_listing(spark, folder):
    names = lambda r: sorted(x.path.rsplit("/", 1)[1] for x in list_media(spark, str(folder), r).collect())
    assert names(False) == ["a.mp4", "b.MKV", "bad.mp4", "c.avi", "cut.flv", "short.mov"]
    assert names(True) == sorted([*names(False), "d.wmv"])
    assert list_media(spark, str(folder / "none")).count() == 0


@pytest.mark.parametrize("n, fps, want", [(500, 25, "ok"), (499, 25, "skipped"), (3, 0.1, "skipped"), (1000, 0, "skipped")])
def test_short_media_are_skipped(tmp_path, n, fps, want):
    media(tmp_path / "x.mp4", 1, n=n, fps=fps)
    assert hash_media(str(tmp_path / "x.mp4"), P, ArrayMedia)[0] == want


def test_a_whole_run(spark, folder, tmp_path):
    db = str(tmp_path / "seen")
    other = tmp_path / "other"
    media(other / "old.mp4", 2)
    assert runs.create_watched(spark, str(other), P, db, open_media=ArrayMedia) == {"added": 1}
    found = runs.find_similar(spark, str(folder), P, watched_db=db, move_duplicates=True, move_skipped=True, open_media=ArrayMedia)
    assert [r.path.rsplit("/", 1)[1] for r in found.watched.filter("is_watched").collect()] == ["c.avi"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.members.collect()) == ["a.mp4", "b.MKV"] and found.groups.count() == 1
    assert found.moved == {"duplicates": (2, 0), "skipped": (3, 0)}
    assert sorted(x.name for x in (folder / "duplicate_videos").iterdir()) == ["a.mp4", "b.MKV"]
    assert found.unwatched.count() == 0
    assert tuple(runs.inspect(spark, db).first()) == (1, 4, 8)
    kept = cache.read_cache(spark, cache_path(str(folder)))
    assert {r.path.rsplit("/", 1)[1]: r.status for r in kept.collect()} == {"a.mp4": "OK", "b.MKV": "OK", "c.avi": "OK", "short.mov": "SKIPPED", "cut.flv": "SKIPPED", "bad.mp4": "SKIPPED"}
    files = list_media(spark, str(folder))
    assert {r["class"] for r in cache.classify(files, cache.prune(kept, files), P).collect()} == {"hit"}


def test_a_linked_folder_is_not_walked(spark, folder, tmp_path):
    media(tmp_path / "else" / "x.mp4", 9)
    (folder / "link").symlink_to(tmp_path / "else")
    assert not any(r.path.endswith("x.mp4") for r in list_media(spark, str(folder), True).collect())


class Broken(ArrayMedia):
    def read(self, index):
        raise ValueError("no such frame")


def test_a_decoder_error_is_a_result(tmp_path):
    media(tmp_path / "x.mp4", 1)
    assert hash_media(str(tmp_path / "x.mp4"), P, Broken) == ("failed", "not decoded: ValueError", None)


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    from twinframe import cli

    monkeypatch.setattr(type(spark.builder), "getOrCreate", lambda self: spark)
    monkeypatch.setattr(runs.find_similar, "__defaults__", tuple(ArrayMedia if d is runs.decode.VideoMedia else d for d in runs.find_similar.__defaults__))
    assert cli.main([str(folder), "-f", "4", "-c", "mine.cache", "--log-file", str(tmp_path / "log")]) == 0
    out = capsys.readouterr().out
    assert "mode: find" in out and "threshold: 90.0" in out and "a.mp4" in out and "b.MKV" in out
    assert (folder / "mine.cache").is_dir() and not (folder / ".video_hashes_cache").exists()
    with pytest.raises(SystemExit):
        cli.main([str(folder), "-t", "101"])
    args = cli.parser().parse_args(["--inspect-db", "seen"])
    assert cli.banner(args, "inspect") == "mode: inspect\nwatched set: seen"


def test_cache_is_kept_from_a_stream(spark, folder, tmp_path):
    from twinframe.streaming.cache_stream import maintain_cache

    list_media(spark, str(folder)).write.parquet(str(tmp_path / "listing"))
    stream = spark.readStream.schema("path string, mtime double, size_bytes bigint").parquet(str(tmp_path / "listing"))
    for _ in range(2):  # the second run has nothing new to do
        maintain_cache(stream, str(tmp_path / "cache"), P, str(tmp_path / "checkpoint"), ArrayMedia).awaitTermination(120)
        kept = cache.read_cache(spark, str(tmp_path / "cache"))
        assert {r.path.rsplit("/", 1)[1]: r.status for r in kept.collect()} == {"a.mp4": "OK", "b.MKV": "OK", "c.avi": "OK", "short.mov": "SKIPPED", "cut.flv": "SKIPPED", "bad.mp4": "SKIPPED"}


def test_a_run_finishes_the_moves_of_one_that_was_stopped(spark, folder, monkeypatch):
    from twinframe.operators import moves

    n, plain = iter(range(100)), moves.shutil.move

    def stopping(src, dest):
        if next(n) == 1:
            raise KeyboardInterrupt
        return plain(src, dest)

    with monkeypatch.context() as m:
        m.setattr(moves.shutil, "move", stopping)
        with pytest.raises(KeyboardInterrupt):
            runs.find_similar(spark, str(folder), P, move_duplicates=True, move_skipped=True, open_media=ArrayMedia)
    found = runs.find_similar(spark, str(folder), P, move_duplicates=True, move_skipped=True, open_media=ArrayMedia)
    assert found.moved == {"duplicates": (2, 0), "skipped": (3, 0)}
    assert sorted(x.name for x in (folder / "duplicate_videos").iterdir()) == ["a.mp4", "b.MKV"]
    assert sorted(x.name for x in (folder / "skipped_videos").iterdir()) == ["bad.mp4", "cut.flv", "short.mov"]
