"""Words above the count threshold have vectors of their own."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import language_model


def test_factored_softmax_is_normalised():
    m = language_model.LogBilinear.fresh(np.arange(300, 0, -1.0), 4)
    assert len(m.groups) > 1
    rng = np.random.default_rng(1)
    m.r[:], m.q1[:], m.groups[:] = rng.normal(size=m.r.shape), rng.normal(size=m.q1.shape), rng.normal(size=m.groups.shape)
    for a, b in ((0, 300), (299, 7)):
        p = np.exp(m.log_probability(np.arange(300), np.full(300, a), np.full(300, b)))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_context_beyond_the_commonest_words_counts(spark):
    """Pairs of rarer words with one first letter: only a word's own vectors tell which second word follows."""
    rng = random.Random(3)
    a, b = [f"za{i}x" for i in range(60)], [f"zb{i}x" for i in range(60)]
    data = [(i, " ".join(f"{a[k]} {b[k]}" for k in (rng.randrange(60) for _ in range(60)))) for i in range(700)]
    data += [(10_000 + i, " ".join(f"c{rng.randrange(1000)}" for _ in range(100))) for i in range(700)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    i = next(i for i, _ in data if held(i) and i < 10_000)
    wrong = " ".join(f"{a[k]} {b[(k + 7) % 60]}" for k in range(60))
    right = " ".join(f"{a[k]} {b[k]}" for k in range(60))
    more = [j for j in range(20_000, 20_100) if held(j)][:2]
    data += [(more[0], right), (more[1], wrong)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    scorer, _ = language_model.fit(df.filter(~language_model.held_out("doc_id")).select(F.col("text").cast("binary").alias("text")), frequent=20)
    assert all(scorer.units[w.encode()] < scorer.units.end for w in a + b)
    got = {r.doc_id: r.score for r in language_model.lm_scores(df, frequent=20).filter(F.col("doc_id").isin(more)).collect()}
    assert got[more[0]] > got[more[1]] + 10, i


def _random_model(scale, n=300, dim=4):
    m = language_model.LogBilinear.fresh(np.arange(n, 0, -1.0), dim)
    rng = np.random.default_rng(2)
    for x in m.tables():
        x[:] = rng.normal(size=x.shape) * scale
    return m, rng


@pytest.mark.parametrize("scale", [0.5, 6.0])
def test_sums_over_shared_units_equal_sums_by_definition(scale):
    """Also where factors leave single precision, and scores are taken one by one."""
    m, rng = _random_model(scale)
    target, one, two = rng.integers(0, 300, 20_000) // 9, rng.integers(0, 60, 20_000), rng.integers(0, 60, 20_000)
    got = m.log_probability(target, one, two)
    q = m.q1[one].astype(float) + m.q2[two]

    def soft(rows, k):
        s = q @ rows[:, :-1].astype(float).T + rows[:, -1]
        top = s.max(axis=1)
        return s[np.arange(len(k)), k] - top - np.log(np.exp(s - top[:, None]).sum(axis=1))

    group = target // m.per
    want = soft(m.groups, group)
    for g in np.unique(group):
        want += np.where(group == g, soft(m.r[g * m.per : (g + 1) * m.per], np.where(group == g, target - g * m.per, 0)), 0)
    assert np.abs(got - want).max() < 1e-4 * max(1.0, np.abs(want).max())


def test_exponentials_are_shared_between_contexts(monkeypatch):
    """20,000 tokens of some 3600 contexts: exponentials are made for their 60 + 60 units, not for each context."""
    m, rng = _random_model(0.5)
    one, two = rng.integers(0, 60, 20_000), rng.integers(0, 60, 20_000)
    target, made, exp = np.zeros(20_000, dtype=np.int64), [], np.exp
    contexts = len(np.unique(one * 1000 + two))
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: made.append(x.size) or exp(x, *a, **k))
    m.log_probability(target, one, two)
    assert sum(made) < contexts * (len(m.groups) + m.per) / 10


def test_words_and_units_of_arrow_texts_are_those_of_single_words():
    """Any bytes, white space other than the six ASCII characters, empty and null texts."""
    rng = random.Random(5)
    some = [b" ", b"\t", b"\x0b", b"\x0c", b"\r", b"\n", b"\x1c", b"\x1f", b"\x85", b"\xc2\xa0", b"\xc3\x84", b"\xe3\x80\x80", b"A", b"z", b"Q9", b"\x00", b"\xff", b".", b"_"]
    texts = [None, b"", b"  ", b" a ", *(b"".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(2000))]
    want = [language_model.words(t) for t in texts]
    flat, sizes = language_model.split(texts)
    assert flat.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]
    units = language_model.Units(list(dict.fromkeys(flat.to_pylist()))[:40], 8)
    got, sizes = units.sequence(texts)
    assert got.tolist() == [k for ws in want for k in (*(units[w] for w in ws), units.end)] and sizes.sum() == len(got)
    for odd in ([], [None, b""]):
        assert language_model.split(odd)[0].to_pylist() == [] and units.sequence(odd)[0].tolist() == [units.end] * len(odd)
