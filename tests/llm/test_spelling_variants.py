"""Near words, forms and roots against all pairs by definition."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinframe.llm import queries
from twinframe.llm import spelling_variants as sv


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(docs, least_length=7, least=2, every=31):
    n = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if k >= least}


def by_definition(n, ratio=10):
    form, count = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        count[w] = len(own)
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    base = ["aaaaaaa", "aaaaaaaa", "Überfluss", "abababab", "garteanlage", "GARTENANLAGE", "straßen", "naturschutz"]
    out = [(0, None), (1, ""), (2, "123 --- 中文"), (None, "gartenanlage gartenanlage"), (None, None), (3, "x" * 3000 + " " + "x" * 2999 + " " + "x" * 3000 + " " + "x" * 2999)]
    for i in range(4, 160):
        said = []
        for _ in range(rng.randint(5, 60)):
            w = rng.choice(base)
            while rng.random() < 0.35:
                p = rng.randrange(len(w))
                w = rng.choice((w[:p] + w[p + 1 :], w[:p] + rng.choice("abtéß") + w[p:], w[:p] + rng.choice("abtéß") + w[p + 1 :]))
            said.append(w)
        out.append((i, rng.choice((" ", "_", "中", "1")).join(said)))
    return out + [out[-1], (5, "gartenanlage " * 40)]


@pytest.fixture(scope="module")
def table(spark, docs):
    return spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, n long, word string")


@pytest.mark.parametrize("block", [50_000, 40, 7])
def test_variants_equal_all_pairs(table, docs, block):
    want = by_definition(words_of(docs))
    assert sorted(map(tuple, sv.spelling_variants(table, block=block).collect())) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_query_equals_sql(spark, table, docs, tmp_path):
    some = table.filter("doc_id is null or doc_id != 3")  # DuckDB's lists of steps are slow on words of 3000 letters
    some.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = by_definition(words_of([d for d in docs if d[0] != 3]))
    got = queries.op13_spelling_variants(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want == sorted(con.execute(queries.SPELLING_SQL).fetchall())


def test_words_flushed_early_are_counted(table, docs):
    got = {r["word"]: r["n"] for r in sv.vocabulary(table, held=3).collect()}
    assert got == words_of(docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=70), st.data())
def test_tree_reports_what_is_in_both_intervals(keys, data):
    values = np.argsort(np.argsort(np.array(keys), kind="stable"), kind="stable")
    n, m = len(values), 25
    ask = np.array(data.draw(st.lists(st.tuples(*[st.integers(0, n)] * 4), min_size=m, max_size=m)))
    q, v = sv.WaveletTree(values).report(*ask.T)
    want = [(i, int(x)) for i, (a, b, c, d) in enumerate(ask.tolist()) for x in values[a:b] if c <= x < d]
    assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == sorted(want)


def test_long_chains_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(23)] + [("u", "w20")]
    got = dict(map(tuple, sv.roots(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert got == {w: "w23" for w, _ in forms}


def test_empty_table(table):
    assert sv.spelling_variants(table.limit(0)).collect() == []
    assert sv.spelling_variants(table.filter("doc_id in (0, 1, 2)")).collect() == []
