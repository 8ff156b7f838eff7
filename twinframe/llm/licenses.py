"""Licence scans by a trained paragraph classifier, in DataFrame operations only (operator 1).

A paragraph is a line, or a block of two lines or more between blank lines, so a notice that is
wrapped over lines is seen as a whole. Its features are the distinct word uni- and bigrams (lower
case, letters and digits) that occur in the licence templates: a sparse multinomial logistic regression over the
licence families and a class ``unknown`` is trained on the templates, on variants of them with
words left out, and on the distinct paragraphs of the corpus for ``unknown``, two thirds of which are
trained on. The unknown class is calibrated on the other third: a family must reach a probability
above all of theirs, or where they are a thousand or more, of all but one in a thousand. A
prediction is confirmed by comparing the paragraph with the family's templates: the part of a
template's bigrams that the paragraph has.

Grams are bounded by the templates, not by the corpus: a paragraph is stored as those that it has, for training and for
the scan. Weights are joined to them by broadcast. Paragraphs that cannot win are left out before that by a bound, not by a guess: a family
can beat ``unknown`` only through a feature that favours it, and each such feature has a word of the
anchor set. Every paragraph
counts in training and calibration; those with the same features are one weighted row.

A licence is reported by its line, or by its block's first line. A block that holds a confirmed line
is not reported itself; of two licences wrapped within one block only the likelier is.

Edge cases. Null and empty texts have no paragraphs and no licences. Equal probabilities go to the
family that comes first in the alphabet. Repeated rows are documents of their own with equal results
(rows are told apart by id and text, so identical rows count once and each gets the result). Extra
columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.sources.shared import materialize

UNKNOWN = "unknown"

#: Wording by which each family of licences is usually declared.
TEMPLATES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL-3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "cc0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "This work is dedicated to the public domain."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL-3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPL-2.1."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this work is prohibited."],
}

#: Parts of a probability that are told apart in calibration.
STEPS = 4096
KEY = ["d1", "d2"]
PLACE = [*KEY, "paragraph", "last"]
SPACE = " \t\r\f\x0b"


def _words(text) -> F.Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _grams(words) -> F.Column:
    """Distinct unigrams and bigrams of an array of words, with the paragraph's ends marked in bigrams."""
    ends = F.concat(F.array(F.lit("^")), words, F.array(F.lit("$")))
    two = F.zip_with(F.slice(ends, 1, F.size(ends) - 1), F.slice(ends, 2, F.size(ends) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, two))


def _with(x, f) -> F.Column:
    """``f`` of a value that is made once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def _marked(words, grams: list[str]) -> F.Column:
    """An array of words with one null for each run of words that occur in none of ``grams``."""
    own = sorted({w for g in grams for w in g.split(" ")})
    known = F.transform(words, lambda w: F.when(w.isin(own), w))
    return _with(known, lambda ws: F.filter(ws, lambda w, i: w.isNotNull() | (i == 0) | F.get(ws, i - 1).isNotNull()))


def _grams_in(marked, grams: list[str]) -> F.Column:
    """Those of ``grams`` that a paragraph with these marked words has."""
    two = lambda ws: F.transform(ws, lambda w, i: F.when(w.isNotNull() & F.get(ws, i + 1).isNotNull(), F.concat_ws(" ", w, F.get(ws, i + 1))))
    known = lambda ws: F.filter(ws, lambda w: w.isin(grams))
    ends = F.concat(F.array(F.lit("^")), marked, F.array(F.lit("$")))
    return _with(ends, lambda ws: F.array_distinct(F.concat(known(ws), known(two(ws)))))


def _grams_of(words, grams: list[str]) -> F.Column:
    """Those of ``grams`` that ``_grams(words)`` has."""
    return _grams_in(_marked(words, grams), grams)


def _paragraphs(docs: DataFrame, text_col: str, grams: list[str], *keep) -> DataFrame:
    """``(*keep, paragraph, last, h, g)``: every line, and every block of lines, with its first and last line's number, its text's hash and those of ``grams`` that it has.

    A line is split into words once: its block takes the words from there.
    """
    src = docs.filter(F.length(text_col) > 0).select(*keep, F.split(text_col, "\n").alias("lines"))
    names = src.columns[:-1]
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.length(F.btrim(F.get("lines", i), F.lit(SPACE))) == 0)
    src = src.select("*", blank.alias("blank"), F.transform("lines", lambda x: _marked(_words(x), grams)).alias("words"))
    unit = lambda a, b, text, words: F.struct(
        a.cast("int").alias("paragraph"), b.cast("int").alias("last"), F.when(F.length(text) > 0, F.xxhash64(text)).alias("h"), words.alias("marked")
    )
    ends = F.transform(F.concat("blank", F.array(F.size("lines"))), lambda b, k: F.struct(F.when(k == 0, 0).otherwise(F.get("blank", k - 1) + 1).alias("a"), (b - 1).alias("b")))
    part = lambda c, e: F.slice(c, e["a"] + 1, e["b"] - e["a"] + 1)
    blocks = F.transform(F.filter(ends, lambda e: e["b"] > e["a"]), lambda e: unit(e["a"], e["b"], F.array_join(part("lines", e), " "), F.flatten(part("words", e))))
    units = F.concat(F.transform("lines", lambda x, i: unit(i, i, x, F.get("words", i))), blocks)
    units = src.select(*names, F.inline(units)).filter(F.col("h").isNotNull())
    return units.select(*names, "paragraph", "last", "h", F.sort_array(_grams_in(F.col("marked"), grams)).alias("g"))


def _doc_keys(id_col: str, text_col: str) -> list:
    """128 bits that stand for a row's id and text."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("d1"), F.xxhash64(F.lit(3), F.col(text_col), F.col(id_col)).alias("d2")]


def _background(docs: DataFrame, text_col: str, grams: list[str]) -> DataFrame:
    """``(g, test, n)``: how many distinct paragraphs that are not nearly a template have those of ``grams``, and whether they are kept from training."""
    return _examples(_paragraphs(docs, text_col, grams))


def _examples(paragraphs: DataFrame) -> DataFrame:
    """The same of ``paragraphs(h, g)``."""
    shapes = [sorted(_bigrams(t)) for ts in TEMPLATES.values() for t in ts]
    overlap = F.exists(F.lit(shapes), lambda s: F.size(F.array_intersect(s, F.col("g"))) >= 0.5 * F.size(s))
    enough = F.size(F.filter("g", lambda x: F.contains(x, F.lit(" ")))) >= min(map(len, shapes)) / 2
    # A paragraph that many documents share is one example.
    rows = paragraphs.select("h", "g").distinct().groupBy("g", (F.pmod("h", F.lit(3)) == 0).alias("test")).agg(F.count("*").alias("n"))
    # Templates are compared once for each set of grams: a condition would be pushed down to the paragraphs, with the making of their grams in it.
    rows = rows.withColumn("near", F.when(enough, overlap).otherwise(False))
    return materialize(rows, "background").filter("not near").drop("near")


def _threshold(scores: DataFrame) -> float:
    """What a family has to reach, from the probabilities ``(p, n)`` that ``n`` paragraphs have: above all of theirs but one in a thousand."""
    steps = {r["step"]: r["n"] for r in scores.groupBy(F.ceil(F.col("p") * STEPS).alias("step")).agg(F.sum("n").alias("n")).collect()}  # STEPS rows at most
    left = sum(steps.values()) // 1000
    held = 0.0
    for step in sorted(steps, reverse=True):
        left -= steps[step]
        if left < 0:
            held = step / STEPS
            break
    return max(0.5, min(held + 0.05, (1 + held) / 2))


class LicenseModel:
    """Weights ``(gram, family, weight)`` against the unknown class, intercepts, the threshold and the anchor words."""

    def __init__(self, weights: list[tuple[str, str, float]], intercepts: dict[str, float], threshold: float, anchors: list[str]):
        self.weights, self.intercepts, self.threshold, self.anchors = weights, intercepts, threshold, anchors


def _template_rows(spark: SparkSession) -> DataFrame:
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    return spark.createDataFrame(rows, "family string, text string").withColumn("words", _words(F.col("text")))


def fit(docs: DataFrame, background: int = 1000, variants: int = 6, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """A model from the templates and all distinct paragraphs of the corpus, which together weigh as much as ``background`` examples at most."""
    return _fit(_paragraphs(docs, text_col, _template_grams()), background, variants)


def _fit(paragraphs: DataFrame, background: int = 1000, variants: int = 6) -> LicenseModel:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    spark = paragraphs.sparkSession
    templates = _template_rows(spark)
    families = sorted(TEMPLATES) + [UNKNOWN]
    grams = _template_grams()
    left_out = lambda v: F.filter("words", lambda w, i: F.pmod(F.xxhash64(w, i, v), F.lit(6)) != 0)
    varied = templates.select("family", "words", F.explode(F.sequence(F.lit(0), F.lit(variants))).alias("v"))
    varied = varied.select("family", F.when(F.col("v") == 0, F.col("words")).otherwise(left_out(F.col("v"))).alias("words"))
    other = _examples(paragraphs)
    total = other.groupBy("test").agg(F.sum("n").alias("n")).collect()
    total, trained = sum(r["n"] for r in total), sum(r["n"] for r in total if not r["test"])
    # Grams that one corpus paragraph in a hundred has say nothing about licences.
    common = other.select(F.explode("g").alias("x"), "n").groupBy("x").agg(F.sum("n").alias("n")).filter(F.col("n") > 0.01 * total).collect()  # bounded by TEMPLATES
    grams = sorted(set(grams) - {r["x"] for r in common})
    # Paragraphs with the same features are one row with their number; all of them together weigh ``background`` examples at most.
    weight = min(1.0, background * 2 / 3 / max(1, trained))
    other = other.groupBy(F.array_sort(F.array_intersect("g", F.lit(grams))).alias("g"), "test").agg(F.sum("n").alias("n"))
    other = other.select(F.lit(UNKNOWN).alias("family"), "g", "test", "n", (F.col("n") * weight).alias("weight"))
    nothing = spark.createDataFrame([(UNKNOWN, [], False, 0, 1.0)], "family string, g array<string>, test boolean, n long, weight double")  # an empty corpus has the class too
    known = varied.select("family", _grams(F.col("words")).alias("g"), F.lit(False).alias("test"), F.lit(0).cast("long").alias("n"), F.lit(1.0).alias("weight"))
    rows = known.unionByName(other).unionByName(nothing)
    index = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))])
    vectors = CountVectorizerModel.from_vocabulary(grams, inputCol="g", outputCol="features").setBinary(True)
    rows = vectors.transform(rows.select(index[F.col("family")].alias("label"), "test", "g", "n", "weight"))
    rows = materialize(rows, "training").cache()
    lr = LogisticRegression(family="multinomial", regParam=0.002, maxIter=40, standardization=False, weightCol="weight")
    model = lr.fit(rows.filter("not test"))
    coef, icpt = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    at = len(families) - 1
    weights = [(g, f, float(coef[i, j] - coef[at, j])) for i, f in enumerate(families[:-1]) for j, g in enumerate(grams) if coef[i, j] != coef[at, j]]
    p = vector_to_array("probability")
    threshold = _threshold(model.transform(rows.filter("test")).select((1 - p[at]).alias("p"), "n"))
    intercepts = {f: float(icpt[i] - icpt[at]) for i, f in enumerate(families[:-1])}
    often = dict(rows.filter(F.col("label") == at).select(F.explode("g").alias("x"), "n").groupBy("x").agg(F.sum("n")).collect())  # bounded by TEMPLATES
    often |= {r["x"]: r["n"] for r in common}
    rows.unpersist()
    return LicenseModel(weights, intercepts, threshold, _anchors(weights, intercepts, often))


def _template_words(template: str) -> list[str]:
    return [x for x in re.split("[^a-z0-9]+", template.lower()) if x]


def _bigrams(template: str) -> set[str]:
    w = ["^", *_template_words(template), "$"]
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def _template_grams() -> list[str]:
    """All uni- and bigrams of the templates."""
    return sorted({g for ts in TEMPLATES.values() for t in ts for g in (*_template_words(t), *_bigrams(t))})


def _anchors(weights, intercepts, often: dict[str, int]) -> list[str]:
    """Words of which a paragraph must have one to score above the unknown class for any family.

    Features are dropped from a family's account, those of the corpus's common words first, as long as
    all dropped ones together leave the family below unknown; each of the rest has its rarest word in
    the set.
    """
    need: set[str] = set()
    rarest = lambda g: min((x for x in g.split(" ") if x not in "^$"), key=lambda x: (often.get(x, 0), x))
    for f, c in intercepts.items():
        gains = sorted(((-often.get(rarest(g), 0), w, g) for g, x, w in weights if x == f and w > 0))
        room = -c - math.log(len(intercepts))  # all families together stay below unknown
        for _, w, g in gains:
            if w < room:
                room -= w
            else:
                need.add(rarest(g))
    return sorted(need)


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(d1, d2, paragraph, last, family, probability, similarity, confirmed)`` of the paragraphs that a family wins."""
    return _scan(_paragraphs(docs, text_col, _template_grams(), *_doc_keys(id_col, text_col)), model)


def _scan(paragraphs: DataFrame, model: LicenseModel) -> DataFrame:
    """The same of ``paragraphs(d1, d2, paragraph, last, g)``, which have the grams of the templates: no others have weights, are anchors or are compared."""
    spark = paragraphs.sparkSession
    found = paragraphs.filter(F.arrays_overlap("g", F.lit(model.anchors).cast("array<string>"))).select(*PLACE, "g").dropDuplicates(PLACE)
    families = sorted(TEMPLATES)
    # Every bigram of a template is looked up, for the comparison, whether the classifier gives it a weight or not.
    grams = {g: [0.0] * len(families) for ts in TEMPLATES.values() for t in ts for g in _bigrams(t)} | {"": [0.0] * len(families)}
    for g, f, w in model.weights:
        grams.setdefault(g, [0.0] * len(families))[families.index(f)] = w
    table = F.broadcast(spark.createDataFrame(list(grams.items()), "gram string, w array<double>"))  # bounded by TEMPLATES
    # One row for each feature that a paragraph has, and one without any, so that none is lost.
    has = found.select(*PLACE, F.explode(F.concat("g", F.array(F.lit("")))).alias("gram")).join(table, "gram")
    sums = [F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(len(families))]
    bigrams = F.collect_set("gram").alias("seen")  # at most the templates' grams
    scored = has.groupBy(*PLACE).agg(*sums, bigrams)
    odds = F.array(*[F.exp(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.lit(model.intercepts[f])) for i, f in enumerate(families)])
    scored = scored.select(*PLACE, "seen", odds.alias("odds"))
    total = F.aggregate("odds", F.lit(1.0), lambda a, x: a + x)
    at = F.array_position("odds", F.array_max("odds")).cast("int")  # the first of equal ones
    won = scored.select(*PLACE, "seen", total.alias("total"), F.array_max("odds").alias("best"), F.element_at(F.array(*map(F.lit, families)), at).alias("family"))
    won = won.filter(1 - 1 / F.col("total") >= model.threshold)
    shapes = spark.createDataFrame([(f, sorted(_bigrams(t))) for f, ts in TEMPLATES.items() for t in ts], "family string, shape array<string>")
    shapes = F.broadcast(shapes.groupBy("family").agg(F.collect_list("shape").alias("shapes")))  # bounded by TEMPLATES
    close = F.array_max(F.transform("shapes", lambda s: F.size(F.array_intersect("seen", s)) / F.size(s).cast("double")))
    out = won.join(shapes, "family").select(*PLACE, "family", (F.col("best") / F.col("total")).alias("probability"), close.alias("similarity"))
    return out.withColumn("confirmed", F.col("similarity") >= 0.6)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, n_paragraphs, licenses, paragraphs)`` of every row: the confirmed families in alphabetical order, and the first lines of the paragraphs that declare them."""
    paragraphs = materialize(_paragraphs(docs, text_col, _template_grams(), *_doc_keys(id_col, text_col)), "paragraphs")
    hits = _scan(paragraphs, _fit(paragraphs, **options)).filter("confirmed")
    per = hits.groupBy(*KEY).agg(F.collect_list(F.struct("paragraph", "last", "family")).alias("hits"))  # a document's own
    lines = F.filter("hits", lambda h: h["paragraph"] == h["last"])
    apart = lambda h: ~F.exists(lines, lambda x: (x["paragraph"] >= h["paragraph"]) & (x["paragraph"] <= h["last"]))
    own = F.filter("hits", lambda h: (h["paragraph"] == h["last"]) | apart(h))
    per = per.select(*KEY, own.alias("hits")).select(*KEY, F.array_sort(F.array_distinct("hits.family")).alias("licenses"), F.array_sort("hits.paragraph").alias("paragraphs"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size(F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)).cast("long")
    src = docs.select(F.col(id_col), *_doc_keys(id_col, text_col), n.alias("n_paragraphs"))
    return src.join(per, KEY, "left").select(
        id_col, "n_paragraphs", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("paragraphs", F.array().cast("array<int>")).alias("paragraphs")
    )

