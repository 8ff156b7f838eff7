"""The nearest join by growing radius against all comparisons."""

import random

import pytest

from twinframe.operators import watched
from twinframe.operators.watched import nearest_distance


def near(h, pool, bits):
    mask = (1 << 64) - 1
    bit = lambda a, b: sum(((x ^ y) & mask).bit_count() for x, y in zip(a, b, strict=True))
    return min([bit(h, p) for p in pool] + [bits])


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bits", [4, 16, 64, 81, 256])
@pytest.mark.parametrize("size", [0, 1, 300])
def test_nearest_is_exact(spark, bits, size):
    rng = random.Random(bits + size)
    widths = [min(64, bits - a) for a in range(0, bits, 64)]
    whole = lambda: [rng.getrandbits(w) for w in widths]
    pool = [whole() for _ in range(size)]

    def off(h, n):
        h = list(h)
        for _ in range(n):
            k = rng.randrange(len(h))
            h[k] ^= 1 << rng.randrange(widths[k])
        return h

    asked = [whole() for _ in range(40)] + [off(rng.choice(pool), rng.choice((0, 1, 3, 8, 20))) for _ in range(120 * bool(pool))]
    one = len(widths) == 1
    kind = "hash bigint" if one else "hash array<bigint>"
    rows = lambda hs: [(signed(h[0]) if one else [signed(x) for x in h],) for h in hs] + [(None,)]
    counts: dict = {}
    out = nearest_distance(spark.createDataFrame(rows(asked + asked[:5]), kind), spark.createDataFrame(rows(pool + pool[:5]), kind), bits, counts=counts)
    got = {(r["hash"],) if one else tuple(r["hash"]): r["distance"] for r in out.collect()}
    assert got == {tuple(signed(x) for x in h): near(h, pool, bits) for h in asked}
    assert (counts["hashes"], counts["pool"]) == (len(got), len({tuple(p) for p in pool}))


def test_a_value_that_many_hashes_share_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(watched, "CROWD", 16)
    rng = random.Random(1)
    pool = [rng.getrandbits(16) for _ in range(500)]  # 48 bits are 0 in all of them
    asked = [rng.getrandbits(18) for _ in range(100)]
    df = lambda x: spark.createDataFrame([(h,) for h in x], "hash bigint")
    got = {r["hash"]: r["distance"] for r in nearest_distance(df(asked), df(pool), 64).collect()}
    assert got == {h: near([h], [[p] for p in pool], 64) for h in asked}


def test_far_fewer_comparisons_than_pairs(spark):
    """Frames that are seen again, up to a few bits, among many: they are not compared with the whole pool."""
    rng = random.Random(2)
    pool = [rng.getrandbits(63) for _ in range(20_000)]
    asked = [p ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for p in pool[:5000]]
    df = lambda x: spark.createDataFrame([(h,) for h in x], "hash bigint")
    counts: dict = {}
    out = {r["hash"]: r["distance"] for r in nearest_distance(df(asked), df(pool), 64, counts=counts).collect()}
    assert max(out.values()) <= 2 and len(out) == len(set(asked))
    compared = sum(n for k, n in counts.items() if k not in ("hashes", "pool"))
    assert compared < counts["hashes"] * counts["pool"] / 500


def test_comparisons_of_the_registered_table(spark):
    """Embeddings' frames of 16 bits are dense: most have a hash near by, and the pool is compared in part."""
    import __spark_entry__ as entry

    e = entry.media._emb(spark, "/root/testdata/sf0.01")
    counts: dict = {}
    nearest_distance(e.filter("label != 0").selectExpr("explode(hashes) AS hash"), entry.media._pool(e), 16, counts=counts).collect()
    compared = sum(n for k, n in counts.items() if k not in ("hashes", "pool"))
    print(counts)
    assert compared < counts["hashes"] * counts["pool"] / 4


def test_tables_whose_rows_become_many_are_not_broadcast(spark):
    """A look-up makes hundreds of rows of one, which Spark's estimate of sizes leaves out; a broadcast goes through the driver."""
    from twinframe.operators import watched
    from twinframe.sources.shared import materialize

    asked, pool = (materialize(spark.range(5000).selectExpr(f"xxhash64(id, {k}) AS {c}"), c) for k, c in ((1, "hash"), (2, "seen")))
    met = watched._by_index(asked, pool, 1, watched._segments(64, 5000), 2)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    rest = watched._by_blocks(asked, pool, 1, 5000, 5000, 1500)
    assert "Join" not in rest._jdf.queryExecution().executedPlan().toString()
    assert rest.groupBy("hash").count().filter("count = 4").count() == 5000  # each met every block of the pool
