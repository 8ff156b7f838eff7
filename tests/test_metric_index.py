"""Range queries of the stored index against all comparisons."""

import random

import pytest

from twinframe.operators import metric_index as mi
from twinframe.sources import versions


def frame(spark, hashes):
    return spark.createDataFrame([(h - (1 << 64) if h is not None and h >> 63 else h,) for h in hashes], "hash bigint")


def within(asked, stored, radius):
    sign = lambda h: h - (1 << 64) if h >> 63 else h
    return sorted({(sign(a), sign(s), (a ^ s).bit_count()) for a in asked for s in stored if (a ^ s).bit_count() <= radius})


def noisy(rng, base, most):
    h = rng.choice(base)
    for _ in range(rng.randrange(most + 1)):
        h ^= 1 << rng.randrange(64)
    return h


@pytest.mark.parametrize("pivots", [1, 4])
def test_stored_and_added_hashes_are_found(spark, tmp_path, pivots):
    rng, at = random.Random(pivots), f"{tmp_path}/index"
    base = [rng.getrandbits(64) for _ in range(12)]
    one, two, asked = ([noisy(rng, base, 9) for _ in range(n)] for n in (150, 90, 60))
    mi.create(spark, at, frame(spark, [*one, one[0], None]), pivots)
    for radius in (0, 3, 12):
        got = sorted(map(tuple, mi.ask(spark, at, frame(spark, [*asked, asked[0], None]), radius).collect()))
        assert got == within(asked, one, radius)
    before = versions.current(spark, at)
    made = mi.add(spark, at, frame(spark, [*two, *one[:30]]))
    assert made.rows("items") == len({*one, *two}) and len(made.tables["items"]) == 2
    assert before.tables["items"].items() <= made.tables["items"].items() and made.tables["pivots"] == before.tables["pivots"]
    for radius in (0, 5, 64):
        assert sorted(map(tuple, mi.ask(spark, at, frame(spark, asked), radius).collect())) == within(asked, [*one, *two], radius)
    assert mi.ask(spark, at, frame(spark, []), 5).collect() == []


def test_pivots_discard_most(spark, tmp_path):
    rng, at, counts = random.Random(9), f"{tmp_path}/index", {}
    base = [rng.getrandbits(64) for _ in range(40)]
    stored, asked = [noisy(rng, base, 3) for _ in range(1500)], [noisy(rng, base, 3) for _ in range(200)]
    mi.create(spark, at, frame(spark, stored), 6)
    got = sorted(map(tuple, mi.ask(spark, at, frame(spark, asked), 2, counts).collect()))
    assert got == within(asked, stored, 2)
    assert counts["compared"] < counts["hashes"] * counts["stored"] / 8


def test_a_crowded_cell_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mi, "CROWD", 10)
    rng, at = random.Random(3), f"{tmp_path}/index"
    stored = [1 << i | 1 << j for i in range(20) for j in range(i)]  # all as far from the first pivot
    mi.create(spark, at, frame(spark, [0, *stored]), 1, sample=1)
    asked = [noisy(rng, stored, 1) for _ in range(40)]
    assert sorted(map(tuple, mi.ask(spark, at, frame(spark, asked), 2).collect())) == within(asked, [0, *stored], 2)


def test_pivots_are_far_apart():
    assert mi.choose_pivots([0, 1, 3, 255, (1 << 64) - 1, 0], 3) == [0, (1 << 64) - 1, 255]
    assert mi.choose_pivots([7, 7], 4) == [7] and mi.choose_pivots([], 2) == []


def test_no_index_and_an_empty_one(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        mi.ask(spark, f"{tmp_path}/none", frame(spark, [1]), 1)
    at = f"{tmp_path}/empty"
    mi.create(spark, at, frame(spark, []))
    assert mi.ask(spark, at, frame(spark, [1]), 64).collect() == []
    mi.add(spark, at, frame(spark, [2]))
    assert [tuple(r) for r in mi.ask(spark, at, frame(spark, [1]), 64).collect()] == [(1, 2, 2)]
    mi.add(spark, at, frame(spark, [2]))
    assert versions.current(spark, at).rows("items") == 1


def test_two_that_add_at_once(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/index"
    mi.create(spark, at, frame(spark, [1]))
    old = versions.current(spark, at)
    mi.add(spark, at, frame(spark, [2]))
    monkeypatch.setattr(mi, "current", lambda *_: old)
    with pytest.raises(versions.Conflict):
        mi.add(spark, at, frame(spark, [3]))
