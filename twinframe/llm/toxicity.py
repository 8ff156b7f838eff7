"""Toxicity scores from a character n-gram linear classifier (operator 8).

A document is the set of its lower-cased, white-space separated words without the ASCII punctuation
at their ends; a word's features are its character n-grams with the word's ends marked, hashed to
``buckets``. Each feature is scaled by its
naive Bayes log-count ratio between toxic and other documents, and a logistic regression on the
scaled features gives the weights (NB-SVM of Wang and Manning 2012, with the logistic loss). The
sum over features is divided by the root of the number of distinct words, and every word has one
more feature of its own, so that neither long clean texts nor short toxic ones drift.

The log-count ratios are counted on the cluster, over the labelled training rows: all of them up to
``labelled`` of both classes together, beyond that about so many of each class, those with the smallest hash of their id. So the labels that
meet the documents have a bound and are broadcast, and no text is shuffled. The regression is fitted
on the driver on about ``sample`` rows of each class (never over twice as many), chosen likewise; its
intercept is then moved to the classes' true proportions. Features whose ratio is small say little; how
small, of the values LEAST, is chosen by the log-loss of two folds of these rows, never by held-out ones. Since the score is a sum over
words, a word's share is computed once per task and remembered in a table of bounded size.

Edge cases. A null or empty text, or one of punctuation alone, has no features, and the score of the intercept alone. A label
that is null, neither 0 nor 1, or of no document teaches nothing; two different labels of one id
teach both. Without any toxic or any clean training row every score is the share of toxic rows
among them (0 without labels). A null id is never a training row and is held out from nothing:
its ``held_out`` is false. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.names import free_name
from twinframe.llm.sampling import smallest
from twinframe.sources.shared import discard, materialize

ORDERS = (3, 4, 5)
#: Smallest sizes of a feature's log-count ratio to choose among.
LEAST = (0.5, 1.0, 1.5, 2.0)
PUNCTUATION = string.punctuation


def grams(word: str, mask: int, orders=ORDERS) -> list[int]:
    """Buckets of a word's character n-grams; the word's ends count as a character each."""
    w, crc = f" {word} ", zlib.crc32
    if w.isascii():  # a slice of the bytes is the bytes of the slice
        b = w.encode()
        return [crc(b[i : i + n]) & mask for n in orders for i in range(len(b) - n + 1)]
    return [crc(w[i : i + n].encode()) & mask for n in orders for i in range(len(w) - n + 1)]


def words(text: str | None) -> set[str]:
    if not text:
        return set()
    out = {w.strip(PUNCTUATION) for w in set(text.lower().split())}
    out.discard("")
    return out


class Shares(dict):
    """What each word adds to a score, computed when first met; it starts anew at its bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.weights, self.mask, self.per_word, self.remember = model.weights.tolist(), len(model.weights) - 1, model.per_word, model.remember

    def __missing__(self, word: str) -> float:
        if len(self) >= self.remember:
            self.clear()
        s = self[word] = sum(map(self.weights.__getitem__, grams(word, self.mask)), self.per_word)
        return s


class Model:
    """Weights by bucket, the weight that any word has, and an intercept."""

    def __init__(self, weights: np.ndarray, per_word: float, intercept: float, remember: int = 400_000):
        self.weights, self.per_word, self.intercept, self.remember = weights.astype(np.float32), float(per_word), float(intercept), remember

    def score_texts(self, texts, shares: Shares | None = None) -> list[float]:
        of, out = (shares or Shares(self)).__getitem__, []
        for t in texts:
            found = words(t)
            # fsum's result does not depend on the order of a set.
            z = self.intercept + math.fsum(map(of, found)) / math.sqrt(max(1, len(found)))
            out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        return out


def held_out(id_col: str, folds: int = 5) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def _class_sizes(df: DataFrame) -> dict[int, int]:
    return {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}


def _labels(docs: DataFrame, labels: DataFrame, labelled: int, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, int] | None]:
    """``(id_, y)``: the training labels, at most twice ``labelled`` of each class; the classes' sizes if some labels were left out."""
    y = labels.select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and id_ is not null")
    y = y.filter(~held_out("id_")).distinct()
    if y.count() <= labelled:
        return y, None
    y = materialize(y.join(docs.select(F.col(id_col).alias("id_")), "id_", "left_semi"), "labels")
    return reduce(DataFrame.unionByName, (smallest(y.filter(F.col("y") == k), F.xxhash64("id_"), labelled) for k in (0, 1))), _class_sizes(y)


def _labelled(docs: DataFrame, y: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).join(F.broadcast(y), "id_")


def _log_ratios(train: DataFrame, buckets: int) -> np.ndarray:
    """Naive Bayes log-count ratio of every bucket, from all rows of ``train``."""

    def count_words(batches):
        import pyarrow as pa

        for b in batches:
            by = (Counter(), Counter())
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                by[y].update(words(t))
            for y, c in enumerate(by):
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(c.keys(), type=pa.string()), pa.array([y] * len(c), type=pa.int32()), pa.array(c.values(), type=pa.int64())], ["word", "y", "n"])

    def count_grams(batches):
        import pyarrow as pa

        total = np.zeros((2, buckets))
        for b in batches:
            found = [grams(x, buckets - 1) for x in b.column("word").to_pylist()]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            at = np.fromiter((g for x in found for g in x), dtype=np.int64, count=int(sizes.sum()))
            for y, name in enumerate(("neg", "pos")):
                total[y] += np.bincount(at, weights=np.repeat(b.column(name).to_numpy(), sizes), minlength=buckets)
        hit = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[0, hit]), pa.array(total[1, hit])], ["bucket", "neg", "pos"])

    counted = train.select("text", "y").mapInArrow(count_words, "word string, y int, n long")
    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    by_word = counted.groupBy("word").agg(of(0).alias("neg"), of(1).alias("pos"))
    by_gram = by_word.mapInArrow(count_grams, "bucket long, neg double, pos double")
    rows = by_gram.groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas()  # at most ``buckets`` rows
    counts = np.ones((2, buckets))
    counts[0, rows["bucket"]] += rows["neg"]
    counts[1, rows["bucket"]] += rows["pos"]
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


class _Rows:
    """The features of some documents, one value for each feature and document."""

    def __init__(self, texts: list[str], ratio: np.ndarray):
        ratio = np.where(np.abs(ratio) >= min(LEAST), ratio, 0.0)
        mask, own = len(ratio) - 1, len(ratio)
        idx, val, ends, known = [], [], [0], {}
        for t in texts:
            found = words(t)
            for x in found:
                if x not in known:
                    g = np.array(grams(x, mask), dtype=np.int32)
                    known[x] = g[ratio[g] != 0]
            got = np.concatenate([known[x] for x in found]) if found else np.empty(0, dtype=np.int32)
            u, c = np.unique(got, return_counts=True)
            size = math.sqrt(max(1, len(found)))
            idx.append(np.append(u, own))
            val.append(np.append(c * ratio[u] / size, 0.1 * len(found) / size))
            ends.append(ends[-1] + len(u) + 1)
        del known
        self.val, self.n = np.concatenate(val), len(texts)
        self.used, self.idx = np.unique(np.concatenate(idx), return_inverse=True)
        self.row = np.repeat(np.arange(len(texts)), np.diff(ends))
        self.size = np.abs(np.append(ratio, np.inf))[self.used]  # a document's number of words always counts

    def fit(self, y: np.ndarray, least: float, rows: np.ndarray | None = None, l2: float = 0.3, steps: int = 100, rate: float = 0.05) -> tuple[np.ndarray, float]:
        """Weights and intercept of a logistic regression on ``rows``, by full-batch Adam; features below ``least`` have none."""
        here = self.size[self.idx] >= least
        if rows is not None:
            here &= rows[self.row]
        idx, val, row, count = self.idx[here], self.val[here], self.row[here], self.n if rows is None else int(rows.sum())
        on = np.ones(self.n) if rows is None else rows.astype(float)
        w, b = np.where(self.size >= least, 0.05, 0.0), 0.0
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for k in range(1, steps + 1):
            z = np.bincount(row, weights=val * w[idx], minlength=self.n) + b
            err = on * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / count
            g, gb = np.bincount(idx, weights=val * err[row], minlength=len(w)) + l2 * w / count, err.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix = math.sqrt(1 - 0.999**k) / (1 - 0.9**k)
            w -= rate * fix * m / (np.sqrt(v) + 1e-10)
            b -= rate * fix * mb / (math.sqrt(vb) + 1e-10)
        return w, b

    def loss(self, y: np.ndarray, rows: np.ndarray, w: np.ndarray, b: float) -> float:
        z = (np.bincount(self.row, weights=self.val * w[self.idx], minlength=self.n) + b)[rows]
        return float(np.logaddexp(0, np.where(y[rows] == 1, -z, z)).mean())


def _regress(texts: list[str], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights (ratios included), a word's own weight and the intercept; the smallest ratio is chosen by two folds."""
    data = _Rows(texts, ratio)
    fold = np.zeros(len(y), dtype=bool)
    for k in (0, 1):  # halves of each class
        fold[np.flatnonzero(y == k)[::2]] = True
    losses = {}
    for least in LEAST:
        parts = [(fold, ~fold), (~fold, fold)] if min((y == 0).sum(), (y == 1).sum()) > 1 else []
        losses[least] = sum(data.loss(y, other, *data.fit(y, least, rows, steps=50)) for rows, other in parts)
    w, b = data.fit(y, min(LEAST, key=lambda x: (round(losses[x], 6), -x)))
    out = np.zeros(len(ratio))
    out[data.used[:-1]] = w[:-1] * ratio[data.used[:-1]]
    return out, 0.1 * float(w[-1]), b


def fit(
    docs: DataFrame, labels: DataFrame, buckets: int = 1 << 18, labelled: int = 100_000, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """A model from the labelled rows that aren't held out.

    ``labelled`` bounds the labels of each class that the log-count ratios are counted over, ``sample``
    the rows of each class that the regression sees; either may be exceeded up to twice.
    """
    y, all_sizes = _labels(docs, labels, labelled, id_col, label_col)
    train = materialize(_labelled(docs, y, id_col, text_col), "labelled")
    n = _class_sizes(train)
    if len(n) < 2:
        p = min(max(float(1 in n), 1e-9), 1 - 1e-9)
        return Model(np.zeros(buckets), 0.0, math.log(p / (1 - p)))
    ratio = _log_ratios(train, buckets)
    rows = []
    for y in (0, 1):
        rows += smallest(train.filter(F.col("y") == y), F.xxhash64("id_"), sample).select("text", "y").collect()
    y = np.array([r["y"] for r in rows])
    weights, per_word, b = _regress([r["text"] for r in rows], y, ratio)
    discard(train)
    n = all_sizes or n
    return Model(weights, per_word, b + math.log(n[1] / n[0]) - math.log(y.sum() / (len(y) - y.sum())))


def score(docs: DataFrame, model: Model, score_col: str = "toxicity", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score_col`` (double, 0 to 1), which must be a new name (see ``free_name``)."""
    if score_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{score_col} is a column already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        import pandas as pd

        shares = Shares(shared.value)
        for texts in batches:
            yield pd.Series(shared.value.score_texts(texts, shares), dtype="float64")

    from collections.abc import Iterator

    import pandas as pd

    rate.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(score_col, F.pandas_udf(rate, T.DoubleType())(F.col(text_col)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, score, predicted)`` of every row."""
    src = docs.select(id_col, text_col)
    at = free_name(src, "toxicity")
    out = score(src, fit(docs, labels, id_col=id_col, text_col=text_col), at, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), F.col(at).alias("score"), (F.col(at) >= 0.5).cast("int").alias("predicted"))
