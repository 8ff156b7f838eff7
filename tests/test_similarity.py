"""Candidates and their verification against all pairs."""

import random
from itertools import combinations

import pytest
from test_operators import brute, signatures

from twinframe.functions.signatures import widest
from twinframe.operators import crowds, similarity
from twinframe.operators.similarity import band_radii, candidates, similar_pairs
from twinframe.params import Params


def noisy(rng, base, flips, bits=64):
    h = [x & (2**64 - 1) for x in base]
    for _ in range(flips):
        h[rng.randrange(len(h))] ^= 1 << rng.randrange(bits)
    return [x - (1 << 64) if x >> 63 else x for x in h]


@pytest.fixture(scope="module")
def sig():
    rng = random.Random(4)
    base = [[rng.getrandbits(64) for _ in range(4)] for _ in range(5)]
    out = {f"p{i:03}": noisy(rng, base[i % 5], rng.choice((0, 0, 2, 8, 12, 19, 20, 21, 40))) for i in range(90)}
    # Frames that are dark in a third of all items: their bands have one value.
    return out | {f"dark{i:03}": [0, 0, 0, rng.getrandbits(62)] for i in range(45)} | {f"copy{i}": [1, 2, 3, 4] for i in range(9)}


@pytest.mark.parametrize("threshold", [92.0, 99.0, 100.0])
@pytest.mark.parametrize("slack", [0, 7, 500])
@pytest.mark.parametrize("crowd", [4096, 5])
def test_bands_find_all_pairs(spark, sig, threshold, slack, crowd):
    p = Params(4, 8, threshold)
    got = {(r.a, r.b): r.similarity for r in similar_pairs(signatures(spark, sig), p, "bands", crowd, slack).collect()}
    assert got == brute(sig, p)


@pytest.mark.parametrize("size, frames, threshold", [(3, 5, 96.0), (9, 2, 97.0), (2, 3, 80.0)])
def test_other_sizes_of_hashes(spark, size, frames, threshold):
    rng, p = random.Random(size), Params(frames, size, threshold)
    sig = {}
    for i in range(60):
        h = []
        for _ in range(frames):
            bits = rng.getrandbits(4) * (rng.getrandbits(size * size) if i % 3 else 1) & ((1 << size * size) - 1)
            h += [bits >> 17, bits & ((1 << 17) - 1)] if size == 9 else [bits]
        sig[f"p{i:02}"] = [x - (1 << 64) if x >> 63 else x for x in h]
    df = signatures(spark, sig)
    want = {(r.a, r.b): r.similarity for r in similar_pairs(df, p, "blocks").collect()}
    assert want == brute(sig, p)
    assert {(r.a, r.b): r.similarity for r in similar_pairs(df, p, "bands").collect()} == want


def test_weight_of_matches_is_a_bound():
    """Whatever way the differing bits fall, a similar pair's matches weigh enough."""
    rng = random.Random(6)
    for most, bands, slack in ((0, 4, 0), (5, 4, 0), (5, 4, 2), (19, 16, 9), (128, 80, 0), (128, 80, 31)):
        radii = band_radii(most, bands, slack)
        total = sum(r + 1 for r in radii)
        assert total == min(2 * bands, most + 1 + slack) and all(-1 <= r <= 1 for r in radii)
        for _ in range(300):
            apart = [0] * bands
            for _ in range(most):
                apart[rng.choice((rng.randrange(bands), 0, 1))] += 1
            assert sum(r + 1 for r, d in zip(radii, apart, strict=True) if d <= r) >= total - most
    with pytest.raises(ValueError):
        band_radii(8, 4)


def test_more_slack_leaves_fewer_pairs_to_verify(spark):
    rng = random.Random(7)
    rows = [(i, *(rng.getrandbits(60) & 0x1111111111111111 for _ in range(4))) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, h0 bigint, h1 bigint, h2 bigint, h3 bigint")
    most = widest(94.0, 4, 64)
    n = [candidates(df, 4, most, 64, slack).count() for slack in (0, 8, 16)]
    assert n[0] > n[1] > n[2] and n[0] < len(list(combinations(rows, 2)))


def test_no_key_has_more_rows_than_a_block(spark, monkeypatch):
    """A value that all share is dealt out: what meets in one key stays near the bound."""
    seen = []
    monkeypatch.setattr(crowds, "materialize", lambda df, *a: seen.append(df) or df)
    df = spark.range(640).selectExpr("id", "0L AS h0", "id AS h1")
    got = candidates(df, 2, 0, 64, 0, 64)
    assert [r["n_"] for r in seen[0].collect()] == [10]
    assert got.count() == 640 * 639 // 2  # equal in the band that is looked at
    blocks = df.selectExpr("pmod(xxhash64(id), 10) AS b").groupBy("b").count().agg({"count": "max"}).first()[0]
    assert blocks < 2 * 64


def test_auto_takes_bands_for_narrow_distances(spark, monkeypatch):
    took = []
    for name in ("_by_bands", "_by_blocks"):
        plain = getattr(similarity, name)
        monkeypatch.setattr(similarity, name, lambda *a, name=name, plain=plain: took.append(name) or plain(*a))
    rng = random.Random(8)
    df = signatures(spark, {str(i): [rng.getrandbits(60)] for i in range(900)})
    for threshold in (100.0, 75.0):
        similar_pairs(df, Params(1, 8, threshold)).count()
    assert took == ["_by_bands", "_by_blocks"]


def test_blocks_are_as_many_as_cores_need(spark):
    cores = spark.sparkContext.defaultParallelism
    many = similarity._blocks(spark, 10_000, 4096)
    assert many * (many + 1) // 2 >= 3 * cores and similarity._blocks(spark, 100, 4096) == 1 and similarity._blocks(spark, 10**6, 4096) == 245


@pytest.mark.parametrize("indexed", [False, True])
@pytest.mark.parametrize("n, most, word_bits", [(20, 128, 64), (4, 19, 16), (3, 0, 64), (2, 60, 64), (8, 51, 64)])
def test_close_pairs_of_a_task(indexed, n, most, word_bits):
    """The sketch and the index lose no pair and give none twice, of one block or of two."""
    import numpy as np

    from twinframe.operators.kernels import Close

    rng = np.random.default_rng(n)
    x = rng.integers(0, 1 << 63, (40, n), dtype=np.uint64)[rng.integers(0, 40, 150)]
    for row in x:  # copies with up to twice as many bits changed
        for bit in rng.integers(0, 64 * n, rng.integers(0, 2 * most + 2)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    x = x & np.uint64((1 << word_bits) - 1)
    far = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2, dtype=int)
    close = Close(n, most, word_bits, indexed)
    for a, b, same in ((x, x, True), (x[:70], x[70:], False)):
        got = sorted(p for i, j, d in close.pairs(a, b, same) for p in zip(i.tolist(), j.tolist(), d.tolist(), strict=True))
        want = [(i, j, int(far[i, j if same else j + 70])) for i in range(len(a)) for j in range(len(b)) if (not same or i < j)]
        assert got == [p for p in want if p[2] <= most] and got


@pytest.mark.parametrize("strategy", ["blocks", "bands"])
def test_wide_distances_shuffle_signatures_and_not_candidates(spark, strategy):
    """Bits that most frames share: each pair agrees in some band. Blocks of one row and empty ones are among them."""
    rng, p = random.Random(9), Params(20, 8, 90.0)
    common = [rng.getrandbits(64) for _ in range(20)]
    sig = {f"p{i:03}": noisy(rng, common, rng.choice((20, 60, 200, 500))) for i in range(60)}
    df = signatures(spark, sig)
    got = [(r.a, r.b, r.similarity) for r in similar_pairs(df, p, strategy, 2).collect()]
    assert len(got) == len(set(got)) and {(a, b): s for a, b, s in got} == brute(sig, p)
    plan = similar_pairs(df, p, strategy, 2)._jdf.queryExecution().toString()
    assert "weight" not in plan


@pytest.mark.parametrize("strategy", ["auto", "blocks", "bands"])
def test_pairs_found_are_joined_to_nothing(spark, strategy):
    """The result may be far larger than the signatures: tasks give it with its paths, and no table is broadcast for it."""
    rng, p = random.Random(10), Params(4, 4, 70.0)
    sig = {f"p{i:02}": [rng.getrandbits(16) & 0x0FF0 for _ in range(4)] for i in range(30)}
    sig |= {f"copy{i}": sig[f"p{i % 3:02}"] for i in range(20)}
    df = signatures(spark, sig)
    got = similar_pairs(df, p, strategy, 7)
    rows = [(r.a, r.b, r.similarity) for r in got.collect()]
    assert len(rows) == len(set(rows)) and {(a, b): s for a, b, s in rows} == brute(sig, p)
    assert "Join" not in got._jdf.queryExecution().toString()


def test_copies_are_compared_once_and_given_all(monkeypatch):
    import numpy as np

    from twinframe.operators import kernels

    monkeypatch.setattr(kernels, "OUT", 7)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 12, (9, 2), dtype=np.uint64)[rng.integers(0, 9, 60)]
    far = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2, dtype=int)
    for a, b, same in ((x, x, True), (x[:25], x[25:], False)):
        got = [p for i, j, d in kernels.close_rows(kernels.Close(2, 6, 64), a, b, same) for p in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)]
        want = [(i, j, int(far[i, j if same else j + 25])) for i in range(len(a)) for j in range(len(b)) if (not same or i < j)]
        assert sorted((min(i, j), max(i, j), d) if same else (i, j, d) for i, j, d in got) == [p for p in want if p[2] <= 6]
