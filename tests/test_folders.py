"""The lister's plans and conditions, files of frames, and the folder that queries are run over."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe import folder_queries
from twinframe.params import Params
from twinframe.sources import listing
from twinframe.sources.decode import hash_media, sample_indices
from twinframe.sources.frames import HEADER, UNREADABLE, FrameFile, write_frames
from twinframe.sources.listing import list_media

P = Params(4, 8, 90.0, 3)


@pytest.fixture
def tree(tmp_path):
    for i in range(3):
        for j in range(4):
            for k in range(2):
                d = tmp_path / f"a{i}" / f"b{j}" / f"c{k}"
                d.mkdir(parents=True)
                (d / "x.mp4").write_bytes(b"x" * (10 * j + k))
                (d / "y.txt").write_text("y")
    (tmp_path / "a0" / "skipped_videos" / "deep").mkdir(parents=True)
    (tmp_path / "a0" / "skipped_videos" / "deep" / "z.mp4").write_bytes(b"z")
    (tmp_path / "a0" / "direct.MOV").write_bytes(b"d")
    return tmp_path


def walked(tree):
    out = set()
    for folder, below, names in os.walk(tree):
        below[:] = [x for x in below if x != "skipped_videos"]
        out |= {os.path.join(folder, x) for x in names if x.lower().endswith((".mp4", ".mov"))}
    return out


@pytest.mark.parametrize("folders", [1, 5, 20, 1000])
def test_levels_are_opened_until_there_are_folders_enough(spark, tree, folders):
    reader = listing._Reader(str(tree), True, folders)
    parts = reader.partitions()
    assert len(parts) >= min(folders, 40) and len({p.path for p in parts}) == len(parts)
    assert {r.path for r in list_media(spark, str(tree), True, folders).collect()} == walked(tree)


def test_conditions_reach_the_lister(spark, tree, monkeypatch):
    df = list_media(spark, str(tree), True, 4)
    some = df.filter(F.col("path").startswith(f"{tree}/a1/b") & (F.col("size_bytes") > 10) & (F.col("size_bytes") <= 30) & F.col("path").endswith("mp4"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("Filter") : plan.index("\n", plan.index("Filter"))]
    assert "EndsWith" in filters and "StartsWith" not in filters and "size_bytes" not in filters  # the rest is the lister's
    want = sorted(p for p in walked(tree) if p.startswith(f"{tree}/a1/b") and 10 < os.path.getsize(p) <= 30)
    assert sorted(r.path for r in some.collect()) == want and len(want) == 4
    assert df.filter(F.col("mtime") > 4e9).count() == 0 and df.filter(F.col("mtime").isNotNull()).count() == len(walked(tree))
    assert df.filter(F.col("path") == f"{tree}/a0/direct.MOV").count() == 1


def test_folders_that_cannot_hold_a_path_are_not_opened(tree, monkeypatch):
    from pyspark.sql.datasource import StringContains, StringStartsWith

    reader, opened = listing._Reader(str(tree), True, 100), []
    rest = StringContains(("path",), "x")
    assert list(reader.pushFilters([StringStartsWith(("path",), f"{tree}/a2/b1/"), rest])) == [rest]
    plain = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(str(p)) or plain(p))
    found = [r[0] for part in reader.partitions() for r in reader.read(part)]
    assert sorted(found) == sorted(f"{tree}/a2/b1/c{k}/x.mp4" for k in range(2))
    assert all(p == str(tree) or p.startswith(f"{tree}/a2") for p in opened) and not any("/b0" in p for p in opened)


def test_a_missing_folder_gives_what_there_is(spark, tree):
    assert list_media(spark, str(tree / "none"), True).count() == 0
    reader = listing._Reader(str(tree), True, 5)
    parts = reader.partitions()
    for k in range(2):
        os.remove(tree / "a0" / "b0" / f"c{k}" / "x.mp4")  # gone after planning
    assert {r[0] for p in parts for r in reader.read(p)} == walked(tree)


def test_only_sampled_frames_are_read(tmp_path, monkeypatch):
    frames = np.random.default_rng(1).integers(0, 1000, (500, 8, 8))
    at = tmp_path / "in" / "x.mp4"
    write_frames(str(at), frames, 10.0, mtime=5.5)
    assert os.path.getmtime(at) == 5.5 and os.path.getsize(at) == HEADER.size + 500 * 256
    read = []
    plain = FrameFile.read
    monkeypatch.setattr(FrameFile, "read", lambda self, i: read.append(i) or plain(self, i))
    status, _, hashes = hash_media(str(at), P, FrameFile)
    assert status == "ok" and read == [499, *sample_indices(500, 4)]
    want = []
    for i in sample_indices(500, 4):
        bits = "".join("01"[int(x)] for x in (frames[i] > frames[i].mean()).ravel())
        want.append(int(bits, 2) - (1 << 64) * (bits[0] == "1"))
    assert hashes == want


@pytest.mark.parametrize(
    "spoil, want",
    [
        (lambda f: f[:-1], ("failed", "last frame unreadable")),
        (lambda f: f[:10], ("failed", "not opened: OSError")),
        (lambda f: b"TFR2" + f[4:], ("failed", "not opened: OSError")),
        (lambda f: f[: HEADER.size + 256 * 20] + UNREADABLE.to_bytes(4, "little") + f[HEADER.size + 256 * 20 + 4 :], ("ok", "")),
        (lambda f: f[: HEADER.size + 256 * 13] + UNREADABLE.to_bytes(4, "little") + f[HEADER.size + 256 * 13 + 4 :], ("failed", "frame unreadable")),
    ],
)
def test_damaged_files(tmp_path, spoil, want):
    at = tmp_path / "x.mp4"
    write_frames(str(at), np.arange(40 * 64).reshape(40, 8, 8), 10.0)
    at.write_bytes(spoil(at.read_bytes()))
    assert sample_indices(40, 4) == [0, 13, 26, 39]
    assert hash_media(str(at), P, FrameFile)[:2] == want


def test_a_file_that_goes_while_it_is_read(tmp_path):
    at = tmp_path / "x.mp4"
    write_frames(str(at), np.zeros((40, 8, 8), dtype=int), 10.0)

    class Going(FrameFile):
        def read(self, index):
            if index == 13:
                os.remove(at)
                raise OSError("stale handle")
            return super().read(index)

    assert hash_media(str(at), P, Going) == ("vanished", "not found", None)


def test_queries_over_a_folder_are_not_empty(spark):
    """Their rows are compared with SQL in the entry tests; here all kinds of results occur."""
    rows = folder_queries.folder_hashes(spark, "/root/testdata/sf0.01").groupBy("status", "reason").count().collect()
    assert {(r.status, r.reason) for r in rows} == {("ok", ""), ("skipped", "short"), ("failed", "last frame unreadable"), ("failed", "frame unreadable"), ("failed", "not opened: OSError"), ("vanished", "not found")}
    moved = folder_queries.folder_moves(spark, "/root/testdata/sf0.01").collect()
    assert {r.path.split("/")[0] for r in moved} >= {"duplicate_videos", "skipped_videos", "src0"}
