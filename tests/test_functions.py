import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.functions import paths
from twinframe.functions import signatures as S
from twinframe.operators.moves import plan_names
from twinframe.params import Params
from twinframe.sources.decode import frame_hash, sample_indices


def test_params_reject_values_out_of_range():
    for bad in ({"threshold": 101}, {"threshold": -1}, {"num_frames": 0}, {"hash_size": 1}, {"skip_duration": -1}):
        with pytest.raises(ValueError):
            Params(**bad)
    assert Params(hash_size=9).words == 2


def test_widest_distance_follows_double_arithmetic():
    assert S.widest(90, 20, 64) == 128
    assert S.similarity_of(1152, 20, 64) < 10 and S.widest(10, 20, 64) == 1151
    assert S.widest(0, 20, 64) == 1280
    for thr in (12.5, 33.3, 70, 75, 85, 99, 100):
        t = S.widest(thr, 4, 16)
        assert S.similarity_of(t, 4, 16) >= thr and (t == 64 or S.similarity_of(t + 1, 4, 16) < thr)


def test_candidate_radius():
    assert [S.candidate_radius(*x) for x in ((90, 64), (70, 16), (85, 81))] == [7, 5, 13]


def test_frame_indices_agree_with_numpy(spark):
    cases = [(1000, 20), (607, 19), (5, 1), (20, 20), (1, 4), (333, 7)]
    for n, k in cases:
        got = spark.range(1).select(S.frame_indices(F.lit(n), k).alias("x")).first()[0]
        assert got == np.linspace(0, max(0, n - 1), k, dtype=int).tolist() == sample_indices(n, k)


def test_average_hash_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    for size in (2, 8, 9):
        grid = rng.normal(size=(size, size))
        got = spark.createDataFrame([(grid.ravel().tolist(),)], "v array<double>").select(S.average_hash(F.col("v"), size * size)).first()[0]
        assert got == frame_hash(grid, size)


def test_similarity_of_signatures(spark):
    sig = {"v1": [15, 0], "v2": [15, 1], "v3": [14, 1], "v4": [0, 15], "v5": [3, 12]}
    want = {("v1", "v2"): 87.5, ("v1", "v3"): 75.0, ("v1", "v4"): 0.0, ("v2", "v5"): 37.5, ("v4", "v5"): 50.0}
    rows = [(sig[a], sig[b], w) for (a, b), w in want.items()] + [([], [], 0.0), ([1], [1, 2], 0.0), ([None, 0], [1, 0], 50.0)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, w double")
    assert all(r[0] == r[1] for r in df.select(S.aligned_similarity(F.col("a"), F.col("b"), 4), "w").collect())


def test_hex_round_trip(spark):
    df = spark.createDataFrame([(0,), (-1,), (1 << 62,), (-(1 << 63),)], "h bigint")
    rows = df.select("h", S.to_hex(F.col("h")).alias("x")).select("h", "x", S.from_hex(F.col("x")).alias("y")).collect()
    assert all(r.h == r.y and r.x == f"{r.h & (2**64 - 1):016x}" for r in rows)


def test_paths_agree_with_posix(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("a./_") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.extension(F.col("p")), paths.basename(F.col("p")), paths.stem(F.col("p"))).collect()
    for p, ext, base, stem in rows:
        assert ext == os.path.splitext(p)[1] and base == os.path.basename(p) and stem == os.path.splitext(os.path.basename(p))[0]


def test_media_and_reserved_names(spark):
    df = spark.createDataFrame([(x,) for x in ("a.mp4", "B.MP4", ".mp4", "c.txt", "x.tar.mov", "sub/d.wmv", "sub/duplicate_videos/e.mp4", "watched_videos/f.mp4", "my_watched_videos/g.flv")], "p string")
    keep = [r[0] for r in df.filter(paths.is_media(F.col("p")) & ~paths.in_reserved_folder(F.col("p"))).collect()]
    assert keep == ["a.mp4", "B.MP4", "x.tar.mov", "sub/d.wmv", "my_watched_videos/g.flv"]


def test_size_texts(spark):
    sizes = {0: "0 B", 512: "512.00 B", 1023: "1023.00 B", 1024: "1.00 KB", 1536: "1.50 KB", 1024**5: "1024.00 TB"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(s,) for s in sizes], "s bigint").select("s", paths.human_size(F.col("s"))).collect()}
    assert got == sizes == {s: paths.human_size_text(s) for s in sizes}
    assert paths.human_size_text("x") == paths.human_size_text(None) == "Invalid size" and paths.human_size_text("1536") == "1.50 KB"


def test_free_names():
    assert plan_names(["m.mp4"] * 3, {"m.mp4", "m_1.mp4"}) == ["m_2.mp4", "m_3.mp4", "m_4.mp4"]
    assert plan_names(["m.mp4"], {"m.mp4", *(f"m_{i}.mp4" for i in range(1, 101))}) == [None]


def test_two_decimals_equal_python(spark):
    rng = random.Random(8)
    values = [0.0, 0.125, 0.375, 2.675, 1.005, 0.005, 0.015, 1e-9, 99.995, 100.0, 87.5, 1023.995, 70368744177663.99, -1.125, -0.001, 2.0**52 + 0.5, 2.0**60]
    values += [rng.uniform(0, 10 ** rng.randint(0, 13)) for _ in range(3000)] + [rng.randrange(1 << 22) / 256 for _ in range(3000)] + [k / 100 + 0.005 for k in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", paths.two_decimals(F.col("v"))).collect()
    assert [r for r in got if f"{r[0]:.2f}" != r[1]] == []
    assert spark.range(1).select(paths.two_decimals(F.lit(None).cast("double"))).first()[0] is None


def test_sizes_half_way_between_two_texts(spark):
    """All sizes that are 128 more than a multiple of 256, up to 16 MB, and random ones."""
    rng = random.Random(9)
    more = [rng.randrange(1 << rng.randint(1, 50)) for _ in range(5000)]
    sizes = spark.range(128, 16 << 20, 256).unionByName(spark.createDataFrame([(x,) for x in more], "id bigint"))
    got = sizes.select("id", paths.human_size(F.col("id"))).collect()
    assert [r for r in got if paths.human_size_text(r[0]) != r[1]] == []


def test_texts_frames_are_hashed_in_batches(spark, tmp_path):
    """As the column expressions give them, also beyond ASCII and with zeros."""
    import random

    from pyspark.sql import functions as F

    from twinframe import queries
    from twinframe.functions.signatures import average_hash, frame_indices

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \0é漢😀z") for _ in range(n)) for n in (1279, 1280, 1281, 1343, 1344, 5000, 20_011)] + [None, "", "a" * 2000]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries._doc_frames(spark, str(tmp_path))
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    at = queries._docs(spark, str(tmp_path)).filter("total_frames >= 20").select("doc_id", "text", F.posexplode(frame_indices(F.col("total_frames"), 20)).alias("frame_idx", "i"))
    points = F.transform(F.split(F.substr("text", F.col("i") * 64 + 1, F.lit(64)), ""), lambda c: F.ascii(c).cast("double"))
    want = at.select("doc_id", "frame_idx", average_hash(points, 64)[0].alias("hash"))
    assert sorted(map(tuple, got.select("doc_id", "frame_idx", "hash").collect())) == sorted(map(tuple, want.collect()))
