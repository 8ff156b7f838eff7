"""Stored tables: commits, conflicts, damage, and the watched set that is built on them."""

import threading
from pathlib import Path

import pytest

from twinframe.params import Params
from twinframe.plans import runs
from twinframe.sources import cache, versions, watched
from twinframe.sources.decode import ArrayMedia

P = Params(2, 2)


def entries(spark, sig):
    return spark.createDataFrame([(k, [f"{h:016x}" for h in v]) for k, v in sig.items()], watched.SCHEMA)


def stored(spark, at):
    items, meta = watched.read_watched(spark, at)
    return {r.video_id: [int(h, 16) for h in r.hashes] for r in items.collect()}, meta


def damage(folder, keep=0):
    for f in sorted(Path(folder).rglob("*.parquet"))[keep:]:
        f.write_bytes(b"PAR1 damaged")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)


def test_a_read_error_does_not_empty_the_set(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/seen"
    watched.write_watched(spark, at, entries(spark, {"a": [1], "b": [2], "c": [3]}), P)

    def broken(*_):
        raise OSError("disk")

    with monkeypatch.context() as m:
        m.setattr(watched, "read_table", broken)
        with pytest.raises(OSError):
            watched.write_watched(spark, at, entries(spark, {"d": [4]}), P)
        assert stored(spark, at) == ({}, None)  # for look-ups only
    with monkeypatch.context() as m:
        m.setattr(watched, "current", broken)
        with pytest.raises(OSError):
            watched.write_watched(spark, at, entries(spark, {"d": [4]}), P)
    assert stored(spark, at) == ({"a": [1], "b": [2], "c": [3]}, {"num_frames": 2, "hash_size": 2})
    assert watched.write_watched(spark, at, entries(spark, {"d": [4]}), P) == {"kept": 3, "added": 1}


@pytest.mark.parametrize("params", [P, Params(3, 2)])
@pytest.mark.parametrize("part", ["items", "meta"])
def test_a_damaged_set_is_not_written_to(spark, tmp_path, params, part):
    at = f"{tmp_path}/seen"
    watched.write_watched(spark, at, entries(spark, {"a": [1], "b": [2], "c": [3]}), P)
    tree = lambda: sorted(x.relative_to(tmp_path) for x in (tmp_path / "seen").rglob("*.parquet"))
    before = tree()
    damage(*versions.current(spark, at).folders(part))
    with pytest.raises(ValueError if part == "items" and params != P else versions.Unreadable):
        watched.write_watched(spark, at, entries(spark, {"d": [4]}), params)
    assert tree() == before and versions.current(spark, at).number == 1
    assert stored(spark, at) == (({"a": [1], "b": [2], "c": [3]} if part == "meta" else {}), None)


@pytest.mark.parametrize("setting", ["spark.sql.files.ignoreCorruptFiles", "spark.sql.files.ignoreMissingFiles"])
def test_files_that_a_session_would_pass_over_are_missed(spark, tmp_path, setting):
    at = f"{tmp_path}/seen"
    new = entries(spark, {str(i): [i] for i in range(40)}).repartition(4)
    version = versions.commit({"items": new}, at, versions.Version())
    files = sorted(Path(*version.folders("items")).rglob("*.parquet"))
    spark.conf.set(setting, "true")
    try:
        if "Corrupt" in setting:
            damage(*version.folders("items"), keep=1)
        else:
            files[0].unlink()
        with pytest.raises(versions.Unreadable):
            versions.read_table(spark, versions.current(spark, at), "items", watched.SCHEMA).collect()
        with pytest.raises(versions.Unreadable):
            watched.write_watched(spark, at, entries(spark, {"d": [4]}), P)
    finally:
        spark.conf.unset(setting)


def test_two_writers_lose_nothing(spark, tmp_path):
    at, errors = f"{tmp_path}/seen", []

    def write(k):
        try:
            watched.write_watched(spark, at, entries(spark, {f"{k}-{i}": [i] for i in range(5)} | {"both": [k]}), P)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got, _ = stored(spark, at)
    assert not errors and len(got) == 16 and versions.current(spark, at).number == 3


def test_of_two_commits_after_one_version_the_second_is_refused(spark, tmp_path):
    at = f"{tmp_path}/t"
    one = versions.write_version(spark.range(3), at)
    versions.write_version(spark.range(5), at, one)
    with pytest.raises(versions.Conflict):
        versions.write_version(spark.range(7), at, one)
    assert versions.read_version(spark, at, "id bigint").count() == 5
    assert len(list((tmp_path / "t" / "table").iterdir())) == 2  # what was refused is gone


def test_a_failed_write_leaves_the_version(spark, tmp_path):
    at = f"{tmp_path}/t"
    versions.write_version(spark.range(3), at)
    with pytest.raises(Exception, match="no such thing"):
        versions.write_version(spark.range(3).selectExpr("raise_error('no such thing') AS id"), at)
    assert versions.read_version(spark, at, "id bigint").count() == 3 and versions.current(spark, at).number == 1


def test_missing_is_empty_and_a_commit_that_says_nothing_is_not(spark, tmp_path):
    at = f"{tmp_path}/t"
    assert versions.read_version(spark, at, "id bigint").collect() == [] and versions.current(spark, at).number == 0
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "commit-000000000001").write_text("{")
    with pytest.raises(versions.Unreadable):
        versions.read_version(spark, at, "id bigint")


def test_vacuum_keeps_the_current_version_and_what_is_being_written(spark, tmp_path):
    at = f"{tmp_path}/t"
    for n in (3, 4, 5):
        versions.write_version(spark.range(n), at)
    (tmp_path / "t" / "table" / "being-written").mkdir()
    assert versions.vacuum(spark, at) == 4  # two commits and their folders
    assert versions.read_version(spark, at, "id bigint").count() == 5 and (tmp_path / "t" / "table" / "being-written").exists()
    assert versions.vacuum(spark, at, grace=-5.0) == 1
    assert versions.write_version(spark.range(6), at).number == 4 and versions.vacuum(spark, f"{tmp_path}/none") == 0


def test_entries_without_an_id_and_repeated_ones(spark, tmp_path):
    at = f"{tmp_path}/seen.dat"
    new = spark.createDataFrame([(None, ["1"]), ("", ["2"]), ("a", ["3"]), ("a", ["4"]), ("a", ["4"])], watched.SCHEMA)
    assert watched.write_watched(spark, at, new, P) == {"added": 1}
    assert [tuple(r) for r in watched.read_watched(spark, f"{tmp_path}/seen")[0].collect()] == [("a", ["4"])]


def test_an_unreadable_cache_is_logged_and_replaced(spark, tmp_path, caplog):
    from test_runs import media

    media(tmp_path / "in" / "a.mp4", 1)
    p, at = Params(4, 8), str(tmp_path / "in" / "c")
    runs.hash_folder(spark, str(tmp_path / "in"), p, cache_name="c", open_media=ArrayMedia)
    damage(tmp_path / "in" / "c")
    signatures, _ = runs.hash_folder(spark, str(tmp_path / "in"), p, cache_name="c", open_media=ArrayMedia)
    assert signatures.count() == 1 and "cannot be read" in caplog.text and cache.read_cache(spark, at).count() == 1


def test_a_failed_job_is_not_taken_for_an_unreadable_cache(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "classify", lambda *_: spark.range(1).selectExpr("raise_error('broken plan') AS path"))
    with pytest.raises(Exception, match="broken plan"):
        runs.hash_folder(spark, str(tmp_path), Params(4, 8), open_media=ArrayMedia)


def cache_rows(spark, rows):
    return spark.createDataFrame([(p, "OK", [h], m, 4, 8) for p, h, m in rows], cache.SCHEMA)


def held(spark, at):
    return {r.path: (r.hashes[0], r.mtime) for r in cache.read_cache(spark, at).collect()}


def files_of(at):
    return {p: p.stat().st_mtime_ns for p in Path(at).rglob("*.parquet")}


def test_a_cache_writes_the_buckets_that_change(spark, tmp_path):
    at, rows = f"{tmp_path}/cache", [(f"/m/{i}.mp4", i, 1.0) for i in range(300)]
    cache.write_cache(cache_rows(spark, rows), at)
    base, before = versions.current(spark, at), files_of(at)
    assert len(base.tables["table"]) > cache.BUCKETS // 2
    new = cache_rows(spark, [("/m/5.mp4", 50, 2.0), ("/m/new.mp4", 7, 2.0)])
    gone = spark.createDataFrame([("/m/9.mp4",), ("/m/never.mp4",)], "path string")
    made = cache.write_changes(spark, at, base, new, gone)
    want = {p: (h, m) for p, h, m in rows} | {"/m/5.mp4": (50, 2.0), "/m/new.mp4": (7, 2.0)}
    del want["/m/9.mp4"]
    assert held(spark, at) == want and made.number == 2
    kept = {p for p, x in made.tables["table"].items() if base.tables["table"].get(p) == x}
    assert len(made.tables["table"]) - len(kept) <= 4
    assert versions.vacuum(spark, at) > 0 and versions.vacuum(spark, at) == 0
    after = files_of(at)
    assert held(spark, at) == want and sum(after.get(p) == t for p, t in before.items()) >= len(kept)
    assert len([p for p in before if p not in after]) >= 3  # what only the older version held
    for n in range(3):  # parts of several versions side by side
        cache.write_changes(spark, at, versions.current(spark, at), cache_rows(spark, [(f"/m/{n}.mp4", 100 + n, 3.0)]), gone.limit(0))
        versions.vacuum(spark, at)
    assert held(spark, at) == want | {f"/m/{n}.mp4": (100 + n, 3.0) for n in range(3)}


def test_a_cache_without_changes_is_not_written(spark, tmp_path):
    at = f"{tmp_path}/cache"
    cache.write_cache(cache_rows(spark, [("/m/1.mp4", 1, 1.0)]), at)
    base, before = versions.current(spark, at), files_of(at)
    none = cache_rows(spark, [])
    assert cache.write_changes(spark, at, base, none, none) == base and files_of(at) == before


def test_a_cache_changed_by_another_is_a_conflict(spark, tmp_path):
    at, one = f"{tmp_path}/cache", [("/m/1.mp4", 1, 1.0)]
    base = cache.write_cache(cache_rows(spark, one), at)
    cache.write_changes(spark, at, base, cache_rows(spark, [("/m/2.mp4", 2, 1.0)]), cache_rows(spark, []))
    with pytest.raises(versions.Conflict):
        cache.write_changes(spark, at, base, cache_rows(spark, [("/m/3.mp4", 3, 1.0)]), cache_rows(spark, []))
    assert set(held(spark, at)) == {"/m/1.mp4", "/m/2.mp4"}


def test_a_bucket_may_become_empty_and_the_last_row_may_go(spark, tmp_path):
    at, one = f"{tmp_path}/cache", [("/m/1.mp4", 1, 1.0)]
    base = cache.write_cache(cache_rows(spark, one), at)
    none = cache_rows(spark, [])
    base = cache.write_changes(spark, at, base, none, cache_rows(spark, one))
    assert held(spark, at) == {} and base.rows("table") == 0
    cache.write_changes(spark, at, base, cache_rows(spark, one), none)
    assert held(spark, at) == {"/m/1.mp4": (1, 1.0)}
