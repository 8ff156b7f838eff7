import itertools
import random

import pytest

from twinframe.functions.signatures import similarity_of
from twinframe.operators.components import connected_components
from twinframe.operators.groups import group_report, similar_groups
from twinframe.operators.moves import move_plan
from twinframe.operators.similarity import similar_pairs
from twinframe.operators.watched import split_watched
from twinframe.params import Params
from twinframe.sources import cache, watched

SIG = {"v1": [15, 0], "v2": [15, 1], "v3": [14, 1], "v4": [0, 15], "v5": [3, 12]}


def signatures(spark, sig):
    return spark.createDataFrame(list(sig.items()), "path string, hashes array<bigint>")


def brute(sig, p):
    out = {}
    for (a, x), (b, y) in itertools.combinations(sorted(sig.items()), 2):
        s = similarity_of(sum(bin((i ^ j) & (2**64 - 1)).count("1") for i, j in zip(x, y, strict=True)), p.num_frames, p.bits)
        if s >= p.threshold:
            out[a, b] = s
    return out


@pytest.mark.parametrize("thr", [80, 50])
def test_groups_of_the_golden_case(spark, thr):
    p = Params(2, 2, thr)
    got = similar_groups(similar_pairs(signatures(spark, SIG), p)).collect()
    want = {80: (["v1", "v2", "v3"], 2, 87.5), 50: (sorted(SIG), 5, 70.0)}[thr]
    assert [(r.members, r.n_edges, r.avg_similarity) for r in got] == [want]


def test_strategies_agree_with_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.getrandbits(64) - (1 << 63) for _ in range(4)] for _ in range(6)]
    sig = {}
    for i in range(60):
        h = list(base[i % 6])
        for _ in range(rng.choice((0, 0, 3, 10, 25))):
            k = rng.randrange(4)
            h[k] = ((h[k] & (2**64 - 1)) ^ (1 << rng.randrange(64)))
            h[k] -= (1 << 64) if h[k] >> 63 else 0
        sig[f"p{i:02}"] = h
    p = Params(4, 8, 92.0)
    want = brute(sig, p)
    df = signatures(spark, sig)
    for how, block in (("blocks", 7), ("bands", 0)):
        got = {(r.a, r.b): r.similarity for r in similar_pairs(df, p, how, block or 4096).collect()}
        assert got == want, how


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201), (201, 202), (200, 202)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_watched_golden_case(spark):
    pool = spark.createDataFrame([(15,), (0,), (None,)], "hash bigint")
    sig = signatures(spark, SIG | {"empty": []})
    got = {r.path: (r.similarity, r.is_watched) for r in split_watched(sig, pool, Params(2, 2, 80)).collect()}
    assert got == {"v1": (100.0, True), "v2": (87.5, True), "v3": (75.0, False), "v4": (100.0, True), "v5": (50.0, False)}
    assert not any(r.is_watched for r in split_watched(sig, pool.limit(0), Params(2, 2, 80)).collect())


def test_cache_classes(spark):
    p = Params()
    files = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0), ("d", 1.0), ("e", 1.0), ("f", 2.0), ("g", 1.0), ("i", 1.0)], "path string, mtime double")
    known = spark.createDataFrame(
        [("a", "OK", [1], 1.0, 20, 8), ("b", "OK", [1], 1.0, 20, 8), ("c", "OK", [1], 1.0, 10, 8), ("d", "OK", [1], 1.0, 20, 16), ("e", "SKIPPED", None, 1.0, 20, 8), ("f", "SKIPPED", None, 1.0, 20, 8), ("h", "OK", [1], 1.0, 20, 8), ("i", "odd", None, 1.0, 20, 8)],
        cache.SCHEMA,
    )
    rows = cache.classify(files, known, p)
    assert {r["path"]: r["class"] for r in rows.collect()} == dict(a="hit", b="stale", c="stale", d="stale", e="skipped", f="stale", g="miss", i="stale")
    assert tuple(cache.stats(rows).first()) == (1, 1, 5, 1)
    assert "h" not in {r.path for r in cache.prune(known, files).collect()}


def test_watched_set_upsert(spark, tmp_path):
    at, p = f"{tmp_path}/seen.db", Params(2, 2)
    assert watched.read_watched(spark, at)[1] is None
    assert watched.write_watched(spark, at, watched.entries(signatures(spark, {"x": [1, 1], "y": [2, 3]})), p) == {"added": 2}
    assert watched.write_watched(spark, at, watched.entries(signatures(spark, {"x": [1], "y": [4], "z": [5]})), p) == {"added": 1, "refreshed": 1, "updated": 1}
    seen, meta = watched.read_watched(spark, at)
    assert seen.count() == 3 and meta == {"num_frames": 2, "hash_size": 2}
    assert {r.hash for r in watched.pool(seen).collect()} == {1, 4, 5}
    assert tuple(watched.summary(seen, meta).first()) == (3, 2, 2)
    with pytest.raises(ValueError):
        watched.write_watched(spark, at, watched.entries(signatures(spark, {"x": [1]})), Params(3, 2))


def test_wide_hashes_against_the_watched_set(spark):
    """A frame of 256 bits is one hash of four words: other frames' words are no match."""
    p = Params(2, 16, 90)
    frame = lambda k: [k, k + 1, k + 2, k + 3]
    seen = watched.entries(signatures(spark, {"old": frame(1) + frame(50)}), p.words)
    assert [sorted(map(len, r.hashes)) for r in seen.collect()] == [[64, 64]]
    sig = {"same": frame(50) + frame(1), "mixed": [2, 1, 4, 3] + [53, 1, 50, 4], "far": [-1] * 8}
    got = {r.path: r.similarity for r in split_watched(signatures(spark, sig), watched.pool(seen, p.words), p).collect()}
    pool = [frame(1), frame(50)]
    bits = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True))
    for path, h in sig.items():
        near = [min(bits(h[i : i + 4], w) for w in pool) for i in (0, 4)]
        assert got[path] == similarity_of(sum(near), 2, 256), path
    assert got["same"] == 100.0 and got["mixed"] < 100.0


def test_a_damaged_watched_set_is_empty(spark, tmp_path):
    at, p = f"{tmp_path}/seen", Params(2, 2)
    watched.write_watched(spark, at, watched.entries(signatures(spark, {"x": [1, 1]})), p)
    for f in (tmp_path / "seen" / "items").rglob("*.parquet"):
        f.write_bytes(b"PAR1 damaged")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    seen, meta = watched.read_watched(spark, at)
    assert seen.count() == 0 and meta is None


def test_numbering(spark):
    from twinframe.operators.numbering import numbered

    df = spark.range(500).selectExpr("id", "id * 7919 % 503 AS x").repartition(7)
    got = {r.x: r.n for r in numbered(df, "n", "x").collect()}
    assert got == {x: k + 1 for k, x in enumerate(sorted(got))} and len(got) == 500
    assert numbered(df.limit(0), "n", "x").count() == 0


def test_copies_are_counted_not_paired(spark):
    from twinframe.operators.groups import group_members, group_scores
    from twinframe.operators.similarity import similar_classes

    sig = {f"c{i:02}": [15, 0] for i in range(30)} | {"d0": [15, 1], "d1": [15, 1], "z": [0, 15]}
    p = Params(2, 2, 80)
    classes, pairs = similar_classes(signatures(spark, sig), p)
    members = group_members(classes, pairs)
    want = brute(sig, p)
    assert [(r.group_id, r.n_members, r.n_edges, r.avg_similarity) for r in group_scores(classes, pairs, members).collect()] == [("c00", 32, len(want), sum(want.values()) / len(want))]
    assert {(r.a, r.b): r.similarity for r in similar_pairs(signatures(spark, sig), p).collect()} == want and pairs.count() == 1


def test_report_and_moves(spark):
    groups = similar_groups(similar_pairs(signatures(spark, SIG), Params(2, 2, 80)))
    sizes = spark.createDataFrame([("v1", 0), ("v2", 2048)], "path string, size_bytes bigint")
    got = sorted((r.group_no, r.path, r.size_text) for r in group_report(groups, sizes).collect())
    assert got == [(1, "v1", "0 B"), (1, "v2", "2.00 KB"), (1, "v3", "File not found")]
    files = spark.createDataFrame([(f"/in/{i}/m.mp4", i) for i in range(3)], "path string, seq int")
    there = spark.createDataFrame([("m.mp4",), ("m_1.mp4",)], "name string")
    assert [r.dest for r in move_plan(files, "/out", there).orderBy("src").collect()] == ["/out/m_2.mp4", "/out/m_3.mp4", "/out/m_4.mp4"]
    assert {r.status for r in move_plan(files, "/out", there, rename=False).collect()} == {"failed"}


def test_group_report_equals_its_sql_on_the_larger_table(spark):
    """Sizes half way between two texts occur there."""
    import __spark_entry__ as entry
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.1/documents.parquet'")
    halves = con.sql("SELECT count(*) FROM documents WHERE n_chars % 1024 IN (128, 640)").fetchall()[0][0]
    want = con.sql("SELECT '/media/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.mp4', printf('%.2f KB', n_chars / 1024.0::DOUBLE) FROM documents WHERE n_chars BETWEEN 1024 AND 1048575").fetchall()
    docs = entry.media._docs(spark, "/root/testdata/sf0.1")
    alone = docs.selectExpr("path AS group_id", "1.0D AS avg_similarity", "path")
    rows = group_report(alone.drop("path"), docs, alone.select("group_id", "path"))
    assert halves > 3 and sorted((r.path, r.size_text) for r in rows.collect() if r.size_text.endswith(" KB")) == sorted(want)
