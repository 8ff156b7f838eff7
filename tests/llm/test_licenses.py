"""Operator 1: wordings that no template holds, licences wrapped over lines, and the scan by definition."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from twinframe.llm import licenses

#: Wordings that are in no template; the model never sees them.
UNSEEN = {
    "agpl": ["This program is distributed under the terms of the GNU Affero General Public License v3.", "License: AGPL-3.0-or-later"],
    "apache": ["This project is made available under the Apache License 2.0.", "Code in this repository is licensed under the Apache License, Version 2.0."],
    "bsd": ["This module is distributed under the terms of the BSD License.", "Use of this source code is governed by a BSD 3-Clause License."],
    "cc0": ["The data are in the public domain under CC0 1.0.", "This dataset has been released into the public domain."],
    "cc-by": ["Text is available under the Creative Commons Attribution 4.0 International License.", "This article is licensed under CC BY 4.0."],
    "cc-by-nc": ["Photos are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Shared under CC BY-NC 4.0."],
    "cc-by-nd": ["This book is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Shared under CC BY-ND 4.0."],
    "cc-by-sa": ["Content is available under a Creative Commons Attribution-ShareAlike 4.0 International License.", "This page is licensed under CC BY-SA 4.0."],
    "gpl": ["This package is released under the GNU General Public License, version 3.", "This library may be used under the terms of the GNU General Public License."],
    "isc": ["This package is made available under the ISC License.", "Distributed under the ISC License."],
    "lgpl": ["This library is released under the GNU Lesser General Public License, version 3.", "Code here is licensed under the LGPL-2.1."],
    "mit": ["This software is distributed under the MIT License.", "The code is made available under the terms of the MIT License."],
    "mpl": ["This add-on is released under the Mozilla Public License, Version 2.0.", "Subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved by the publisher.", "Unauthorized copying of this document is prohibited."],
}

#: Sentences about the same words that grant nothing.
CLEAN = [
    "The committee discussed the general public and its right to a license plate.",
    "Version 2.0 of the report was released in May under the old title.",
    "She reserved all seats on the right side of the hall.",
    "The students at MIT built a license server in 1998.",
    "A driving license is issued under the terms of the road act.",
    "The public library is free of charge to any person in the city.",
    "Apache helicopters were sold under a licence of the ministry.",
    "Commons attribution of the share price was not provided.",
]


def prose(seed: int, n: int = 20) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


def wrapped(text: str, width: int) -> str:
    words, lines = text.split(" "), []
    for i in range(0, len(words), width):
        lines.append(" ".join(words[i : i + width]))
    return "\n".join(lines)


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def bigrams_of(words: list[str]) -> set[str]:
    ends = ["^", *words, "$"]
    return {f"{a} {b}" for a, b in zip(ends, ends[1:], strict=False)}


def units_of(text: str) -> list[tuple[int, int, str]]:
    """Lines, and blocks of two lines or more between blank ones."""
    lines = (text or "").split("\n")
    out, block = [(i, i, x) for i, x in enumerate(lines)], []
    for i, x in enumerate([*lines, ""]):
        if x.strip(" \t\r\f\x0b"):
            block.append(i)
        else:
            if len(block) > 1:
                out.append((block[0], block[-1], " ".join(lines[j] for j in block)))
            block = []
    return out


def by_definition(text: str, model) -> dict:
    """All weights for every paragraph, without anchors: ``{(first, last): (family, probability, similarity)}`` of the winners."""
    out, families = {}, sorted(licenses.TEMPLATES)
    for a, b, line in units_of(text):
        words = words_of(line)
        grams = set(words) | bigrams_of(words)
        if not words:
            continue
        odds = {f: math.exp(model.intercepts[f] + sum(w for g, x, w in model.weights if x == f and g in grams)) for f in families}
        total = 1 + sum(odds.values())
        if 1 - 1 / total >= model.threshold:
            best = max(families, key=lambda f: odds[f])
            shapes = [bigrams_of(words_of(t)) for t in licenses.TEMPLATES[best]]
            out[a, b] = (best, odds[best] / total, max(len(s & grams) / len(s) for s in shapes))
    return out


MIT = licenses.TEMPLATES["mit"][2]
TEXTS = [
    prose(1),
    f"{prose(2)}\n\n{wrapped(MIT, 5)}\n\n{prose(3)}",  # wrapped, a block alone
    f"{prose(4)}\n{wrapped(MIT, 7)}\n{prose(5)}",  # wrapped amid other lines
    f"{licenses.TEMPLATES['apache'][0]}\n{prose(6)}",  # a line in a block of two
    f"\n \n{wrapped(licenses.TEMPLATES['gpl'][2], 9)}\n\t\n\n{wrapped(licenses.TEMPLATES['bsd'][2], 4)}\n",
    "All rights\nreserved.",
    f"{MIT}\n\n{wrapped(licenses.TEMPLATES['isc'][1], 6)}",
    " \n\t\n",
    "",
    None,
    "\n\n\n",
    *CLEAN,
    *("\n\n".join(UNSEEN[f]) for f in UNSEEN),
    *(f"{licenses.TEMPLATES[f][0]}\n{prose(k, 400)}" for k, f in enumerate(sorted(licenses.TEMPLATES))),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate([*TEXTS, *(f"{prose(1000 + k)}\n{prose(2000 + k)}" for k in range(300))])), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def model(table):
    return licenses.fit(table)


def test_scan_equals_all_weights_on_every_paragraph(table, model):
    """No anchor words, no joins: what the bound leaves out could not have won."""
    from pyspark.sql import functions as F

    key = table.select("doc_id", F.xxhash64("doc_id", "text").alias("d1"))
    got = {(r.doc_id, r.paragraph, r.last): r for r in licenses.scan(table, model).join(key, "d1").collect()}
    want = {(i, *at): v for i, t in enumerate(TEXTS) for at, v in by_definition(t, model).items()}
    assert {k: r.family for k, r in got.items()} == {k: v[0] for k, v in want.items()}
    for k, r in got.items():
        assert r.probability == pytest.approx(want[k][1], abs=1e-9) and r.similarity == pytest.approx(want[k][2], abs=1e-12)
        assert r.confirmed == (r.similarity >= 0.6)


def test_wrapped_licences_are_found_at_their_first_line(table):
    got = {r.doc_id: (r.n_paragraphs, r.licenses, r.paragraphs) for r in licenses.license_scan(table).collect()}
    assert len(got) == table.count()
    assert got[1] == (6, ["mit"], [2])
    assert got[2][1:] == (["mit"], [0])
    assert got[3] == (2, ["apache"], [0])
    assert got[4][1:] == (["bsd", "gpl"], [2, 8])  # 2 to 5, blank, blank, 8 on
    assert got[5][1:] == (["proprietary"], [0])
    assert got[6][1:] == (["isc", "mit"], [0, 2])
    for i in (0, 7, 8, 9, 10):
        assert got[i][1:] == ([], [])
    assert got[9][0] == got[8][0] == got[7][0] == got[10][0] == 0


def test_unseen_wordings(spark, model):
    """Held-out wording: at least four fifths get their family, three fifths are confirmed, nothing clean is, nothing is confirmed wrongly."""
    from pyspark.sql import functions as F

    rows = [(f, w) for f, ws in UNSEEN.items() for w in ws] + [(None, c) for c in CLEAN]
    assert not {w for _, w in rows} & {t for ts in licenses.TEMPLATES.values() for t in ts}
    df = spark.createDataFrame([(i, f, w) for i, (f, w) in enumerate(rows)], "doc_id long, want string, text string")
    key = df.select("want", F.xxhash64("doc_id", "text").alias("d1"))
    got = licenses.scan(df, model).join(key, "d1").collect()
    n = len(rows) - len(CLEAN)
    assert sum(r.family == r.want for r in got) >= 0.8 * n
    assert sum(r.family == r.want and r.confirmed for r in got) >= 0.6 * n
    assert all(r.family == r.want for r in got if r.confirmed)


def test_every_paragraph_counts(spark):
    """Beyond the weight of a thousand examples too: counts are those of all distinct paragraphs, and so is the threshold."""
    lines = [f"the rights of number {i}" for i in range(3000)] + ["all rights of the author", "no paragraph of this kind"]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::50])) for i in range(50)] * 2, "doc_id long, text string")
    grams = ["rights", "of", "the", "author"]
    rows = licenses._background(docs, "text", grams)
    blocks = 50  # each text of several lines is a paragraph too
    assert rows.agg(F.sum("n")).first()[0] == len(lines) + blocks
    assert rows.filter(F.array_contains("g", "author")).agg(F.sum("n")).first()[0] == 2
    scores = lambda xs: spark.createDataFrame(xs, "p double, n long")
    assert licenses._threshold(scores([(0.9, 1), (0.6, 3), (0.1, 995)])) == pytest.approx(0.95, abs=1e-3)
    assert licenses._threshold(scores([(0.9, 1), (0.6, 3), (0.1, 996)])) == pytest.approx(0.65, abs=1e-3)
    assert licenses._threshold(scores([])) == 0.5
    rng, some = random.Random(3), ["rights", "of", "the", "author", "rights of", "^ all", "author $", "^ rights"]
    texts = spark.createDataFrame([([rng.choice(("all", "rights", "of", "the", "author", "x")) for _ in range(rng.randrange(9))],) for _ in range(200)], "words array<string>")
    got = texts.select(F.array_sort(licenses._grams_of(F.col("words"), some)).alias("a"), F.array_sort(F.array_intersect(licenses._grams(F.col("words")), F.lit(some))).alias("b"))
    assert got.filter("a != b").count() == 0


def test_words_are_made_once(table, monkeypatch):
    """A condition on grams that is pushed down to the paragraphs has their making in it, once for each use."""
    plans, write = [], licenses.materialize
    monkeypatch.setattr(licenses, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, tag))
    licenses._background(table, "text", licenses._template_grams())
    assert len(plans) == 1 and plans[0].count("[^a-z0-9]+") == 1


def test_repeated_rows_count_once(table, model):
    """A repeated row's paragraphs have the same probability as one's."""
    rows = lambda df: {(r.d1, r.paragraph, r.last): (r.family, round(r.probability, 9)) for r in licenses.scan(df, model).collect()}
    once = rows(table)
    assert once and rows(table.unionAll(table)) == once


def test_runs_of_unknown_words_part_what_is_known(spark):
    """A run is one null, so no two words or ends meet over it."""
    df = spark.createDataFrame([(["x", "y", "all", "x", "x", "rights", "reserved", "z", "z"],), (["all", "rights"],), ([],), (["x"],)], "words array<string>")
    grams = ["all", "rights", "^ all", "all rights", "rights reserved", "reserved $", "rights $", "^ $"]
    got = [sorted(r[0]) for r in df.select(licenses._grams_of(F.col("words"), grams)).collect()]
    assert got == [["all", "rights", "rights reserved"], ["^ all", "all", "all rights", "rights", "rights $"], ["^ $"], []]
