"""The filter audit against filters applied one after the other, in all orders."""

import random
import re
from itertools import permutations

import duckdb
import pytest

from twinframe.llm import filter_audit, queries


def by_definition(docs, labels):
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(smallest.get(text or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and smallest[text] < i,
        }
        rows.append((part or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, lost, found = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                lost[x] += len(gone)
                fails = sum(r[1][x] for r in own)
                alone = sum(r[1][x] and sum(r[1].values()) == 1 for r in own)
                found.append([part, order, step, len(left), len(gone), fails - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone), x])
        out += [(*f[:-1], lost[f[-1]]) for f in found]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    say = lambda n, k: " ".join(rng.choice([f"w{j}" for j in range(k)]) for _ in range(n))
    same = say(220, 300)
    docs = [(0, None, "a"), (1, "", None), (2, " \t\n", ""), (None, same, "a"), (None, same, "a"), (3, "ÀÉ" * 30 + "A", "b")]
    docs += [(i, rng.choice((same, same + "#", say(210, 400), say(210, 20), say(40, 100), say(210, 400).upper(), say(3, 9) + "|", "")), rng.choice(("a", "b", None, "c"))) for i in range(4, 120)]
    docs += [docs[20], docs[20], (4, same, "b"), (4, same, "b"), (4, same, "c")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 110, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, rows):
    docs, labels = rows
    return (
        spark.createDataFrame([(i, t, p, 7, "x") for i, t, p in docs], "doc_id long, text string, source string, mask int, part string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_audit_equals_filters_in_turn(tables, rows):
    want = by_definition(*rows)
    for parts in (None, 5):
        out = filter_audit.filter_audit(*tables, partitions=parts)
        assert sorted(map(tuple, out.collect())) == want
    assert all(len(r) == 10 for r in want) and len(want) == 600 * len({d[2] or "" for d in rows[0]})


def test_query_equals_sql(spark, tables, rows, tmp_path):
    for name, df in zip(("documents", "labels"), tables, strict=True):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.op12_filter_audit(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.FILTER_AUDIT_SQL).fetchall()) == by_definition(*rows)


def test_chains_compare_whole_texts_whatever_the_fingerprints():
    rows = {("p", 0): 1}
    chains = filter_audit.Chains()
    lost = [x for i, t in ((3, b"a"), (2, b"b"), (1, b"a"), (5, b"b"), (1, b"a"), (4, b"a")) for x in chains.add(9, t, i, rows)]
    assert lost == [(3, "p", filter_audit.COPY, 1), (5, "p", filter_audit.COPY, 1), (4, "p", filter_audit.COPY, 1)]
    assert [x[1] for x in chains.items()] == [(b"a", 1, {("p", 0): 2}), (b"b", 2, {("p", 0): 1})]


def test_small_chains_give_the_same(rows):
    docs, _ = rows
    src = [(i, t, p) for i, t, p in docs]

    def run(most, cuts):
        out = [x for k in range(cuts) for x in filter_audit._local(iter(src[k::cuts]), most)]
        done = list(filter_audit._routed(iter(sorted(out, key=lambda x: x[0]))))
        total = {}
        for i, part, mask, n in done:
            total[i, part, mask] = total.get((i, part, mask), 0) + n
        return total

    assert run(0, 4) == run(1 << 30, 1) == run(3000, 3)


def test_empty_tables(spark, tables, rows):
    docs, labels = tables
    assert filter_audit.filter_audit(docs.limit(0), labels).collect() == []
    assert sorted(map(tuple, filter_audit.filter_audit(docs, labels.limit(0)).collect())) == by_definition(rows[0], [])
