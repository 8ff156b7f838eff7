"""Words that differ by one inserted, deleted or replaced character, and the form that each stands for (operator 13).

Two words are near if a third string, one of them with a gap at some position, fits both: what is
before the gap is a prefix of both, what is after it a suffix. For one length of the longer word, a
gap at position p leaves p characters before and length - 1 - p after it, whether the other word has
the same length (replaced) or one character less (inserted or deleted). Words of the length, in
forward order, are a sequence of their places in reverse order; those with a prefix are an interval
of the one order and those with a suffix of the other, and the words that fit are the points in both.
A wavelet tree over the sequence reports them, for all words and positions of a shard at once.

Shards. A gap in the later half leaves the first half as it is, and one in the earlier half the rest;
words are dealt by a hash of that half, so a shard has all words that can meet there, and about
``block`` of them (fewer of more than 16 letters). A half that more than ``block`` words share is dealt into blocks of words that are
found and blocks of words that look, and every pair of blocks is a shard. Each pair of near words is
found in one shard (a repeated letter is inserted after its last repetition), and only the count of a
word's near words and the largest of them leave it.

Roots follow forms by pointer doubling. A form occurs at least ``ratio`` times as often as its word, so
chains are short and without cycles.

Edge cases. A null text has no words. A null id is the empty string in a word's hash; rows that repeat
an id count like others. Runs are cut by any character but A-Z, a-z and those from U+00C0 to U+00FF;
a word has at most as many characters as its text, and no length is cut off. Extra columns are
ignored. An empty table gives no words. Equal counts are decided by code points.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.blocks import grouped, runs
from twinframe.llm.slices import slices
from twinframe.sources.shared import discard, materialize

#: Every byte of Latin-1 to its letter in lower case (A-Z only), or to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
SHARD = ["size", "late", "part", "found", "looks"]


def word_of(run: bytes, crc: int, every: int) -> bytes:
    """The word that a run counts for; ``crc`` is that of the document's id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least_length: int = 7, least: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text", held: int = 200_000) -> DataFrame:
    """``(word, n)``: words of the texts and how often they occur."""

    def run(batches):
        import pyarrow as pa

        counts: Counter = Counter()

        def out():
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), pa.array(counts.values(), type=pa.int64())], ["word", "n"])

        for batch in batches:
            for b in slices(batch, "text", 4096):
                for id_, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    crc = zlib.crc32(f"{id_}:".encode())
                    said = Counter(w for w in (text or "").encode("latin-1", "replace").translate(_FOLD).split() if len(w) >= least_length)
                    for w, n in said.items():
                        if len(w := word_of(w, crc, every)) >= least_length:
                            counts[w] += n
                    if len(counts) > held:
                        yield out()
                        counts = Counter()
        if counts:
            yield out()

    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class WaveletTree:
    """A sequence of numbers below 2^bits, level by level from their highest bit, zeros of a level before its ones."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int64))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def report(self, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries of places ``[begin, end)`` and values ``[low, high)``: numbers of queries and the values found there."""
        query = np.flatnonzero((begin < end) & (low < high))
        begin, end, low, high = (x[query] for x in (begin, end, low, high))
        base = np.zeros(len(query), dtype=np.int64)
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros, half = self.ones[i], self.zeros[i], np.int64(1 << level)
            one_b, one_e = ones[begin], ones[end]
            left = (begin - one_b < end - one_e) & (low < base + half) & (high > base)
            right = (one_b < one_e) & (high > base + half) & (low < base + 2 * half)
            query, low, high = (np.concatenate((x[left], x[right])) for x in (query, low, high))
            begin, end = np.concatenate(((begin - one_b)[left], (zeros + one_b)[right])), np.concatenate(((end - one_e)[left], (zeros + one_e)[right]))
            base = np.concatenate((base[left], base[right] + half))
        return np.repeat(query, end - begin), np.repeat(base, end - begin)


class Order:
    """Words in lexical order, in which those with a common prefix are an interval."""

    def __init__(self, words: np.ndarray, found: np.ndarray):
        size = words.dtype.itemsize
        self.at = np.argsort(words, kind="stable")
        letters = words[self.at].view(np.uint8).reshape(len(words), size)
        same = np.cumprod(letters[1:] == letters[:-1], axis=1, dtype=np.uint8) if len(words) > 1 else np.zeros((0, size), dtype=np.uint8)
        self.common = same.sum(axis=1)  # with the word before
        self.before = np.concatenate(([0], np.cumsum(found[self.at])))
        self.place = np.empty(len(words), dtype=np.int64)
        self.place[self.at] = np.arange(len(words))

    def interval(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the interval of words to be found that share its first ``depth`` letters."""
        new = self.common < depth
        cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [len(self.at)]))
        group = np.concatenate(([0], np.cumsum(new)))[self.place]
        return self.before[cuts[group]], self.before[cuts[group + 1]]


def near_in_shard(words: np.ndarray, n: np.ndarray, found: np.ndarray, looks: np.ndarray, size: int, gaps: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the number of near words, and the count and the row of the largest (-1: none).

    ``words`` are of ``size`` or ``size - 1`` letters; those to be found are of ``size``, and gaps are in ``gaps``.
    """
    rows = len(words)
    length = np.char.str_len(words)
    letters = words.view(np.uint8).reshape(rows, size)
    # Reversed, with padding at the end again.
    back = np.take_along_axis(letters, (length[:, None] - 1 - np.arange(size)) % size, axis=1)
    back[np.arange(size) >= length[:, None]] = 0
    ahead, behind = Order(words, found), Order(np.ascontiguousarray(back).view(f"S{size}").ravel(), found)
    forward, reverse = ahead.at[found[ahead.at]], behind.at[found[behind.at]]
    rank = np.empty(rows, dtype=np.int64)
    rank[reverse] = np.arange(len(reverse))
    tree = WaveletTree(rank[forward])
    count, best, of = np.zeros(rows, dtype=np.int64), np.full(rows, -1, dtype=np.int64), np.full(rows, -1, dtype=np.int64)

    def note(word: np.ndarray, other: np.ndarray) -> None:
        np.add.at(count, word, 1)
        order = np.lexsort((ahead.place[other], -n[other], word))
        word, other = word[order], other[order]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else order
        word, other = word[first], other[first]
        better = (of[word] < 0) | (n[other] > best[word]) | ((n[other] == best[word]) & (ahead.place[other] < ahead.place[of[word]]))
        best[word[better]], of[word[better]] = n[other[better]], other[better]

    for p in gaps:
        a, b = ahead.interval(p)
        c, d = behind.interval(size - 1 - p)
        # A word that is to be found meets itself.
        asks = np.flatnonzero(looks & (b - a > found) & (d - c > found))
        for some in np.array_split(asks, max(1, -(-len(asks) // 50_000))):
            q, value = tree.report(a[some], b[some], c[some], d[some])
            word, other = some[q], reverse[value]
            # Of the places for an inserted letter the last one counts.
            once = np.where(length[word] == size, word != other, (p >= size - 1) | (letters[word, min(p, size - 1)] != letters[other, p]))
            word, other = word[once], other[once]
            note(word, other)
            shorter = length[word] < size
            note(other[shorter], word[shorter])
    return count, best, of


def _shards(words: DataFrame, block: int) -> DataFrame:
    """Words for every shard that they are found in or look in (see ``SHARD``), with ``finds`` and ``asks``."""
    length = F.length("word")
    roles = F.array(F.struct(length.alias("size"), F.lit(True).alias("full")), F.struct((length + 1).alias("size"), F.lit(False).alias("full")))
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.size", "r.full")
    half = F.floor(F.col("size") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(1).alias("late"), F.xxhash64(F.substr("word", F.lit(1), half)).alias("key")),
        F.struct(F.lit(0).alias("late"), F.xxhash64(F.expr("right(word, size - CAST(size / 2 AS INT))")).alias("key")),
    )
    rows = rows.withColumn("h", F.explode(halves)).select("word", "n", "size", "full", "h.late", "h.key")
    # As many shards as the words of a length fill, and blocks for keys that fill more than one. Long words have smaller ones.
    room = F.greatest(F.lit(1.0), F.floor(F.lit(16.0 * block) / F.greatest("size", F.lit(16)))).cast("double")
    full = rows.groupBy("size", "late").agg(F.count("*").alias("rows_")).filter(F.col("rows_") > room)  # a row for each length that fills a shard
    crowded = materialize(rows.groupBy("size", "late", "key").agg(F.count("*").alias("own_")).filter(F.col("own_") > room), "crowded")
    rows = rows.join(F.broadcast(full), ["size", "late"], "left")
    rows = rows.withColumn("own_", F.lit(None).cast("long")) if crowded.isEmpty() else rows.join(crowded, ["size", "late", "key"], "left")
    blocks = F.coalesce(F.ceil(F.col("own_") / room), F.lit(1)).cast("int")
    part = F.when(F.col("own_").isNull(), F.pmod("key", F.coalesce(F.ceil(F.col("rows_") / room), F.lit(1)))).otherwise(F.col("key"))
    rows = rows.select("word", "n", "size", "full", "late", part.alias("part"), blocks.alias("blocks"), F.pmod(F.xxhash64("word", F.lit(7)), blocks).cast("int").alias("own"))
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    finds = rows.filter("full").withColumn("looks", spread).withColumn("found", F.col("own")).withColumn("finds", F.lit(True)).withColumn("asks", F.col("own") == F.col("looks"))
    asks = rows.withColumn("found", spread).filter("not full or found != own").withColumn("looks", F.col("own")).withColumn("finds", F.lit(False)).withColumn("asks", F.lit(True))
    cols = [*SHARD, "word", "n", "finds", "asks"]
    return finds.select(*cols).unionByName(asks.select(*cols))


def near_words(words: DataFrame, block: int = 50_000, partitions: int | None = None) -> DataFrame:
    """``(word, n_near, near_n, near)`` of words ``(word, n)`` that have near ones: how many, and the largest."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for g in runs(batches, SHARD):
            size, late = int(g["size"][0]), g["late"][0] == 1
            found, looks = g["finds"].astype(bool), g["asks"].astype(bool)
            if not found.any():
                continue
            own = np.array([w.encode("latin-1") for w in g["word"]], dtype=f"S{size}")
            count, best, of = near_in_shard(own, g["n"].astype(np.int64), found, looks, size, range(size // 2, size) if late else range(size // 2))
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g["word"][at], type=pa.string()), pa.array(count[at]), pa.array(best[at]), pa.array(g["word"][of[at]], type=pa.string())], ["word", "n_near", "near_n", "near"]
            )

    n = partitions or int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = grouped(_shards(words, block), SHARD, n).mapInArrow(run, "word string, n_near bigint, near_n bigint, near string")
    # Of the largest the first by code points: the least of (-n, word).
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("near_n"), F.col("b.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: the last form reached, for words that have one."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        more = not moved.filter("moved").isEmpty()
        discard(now)
        now = moved.drop("moved")
        if not more:
            return now
        now._shared_path = moved._shared_path


def spelling_variants(docs: DataFrame, least_length: int = 7, least: int = 2, ratio: int = 10, every: int = 31, block: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of all words; ``least_length`` is 2 at least."""
    words = materialize(vocabulary(docs, least_length, least, every, id_col, text_col), "words")
    near = near_words(words, block)
    held = materialize(words.join(near, "word", "left"), "near-words")
    ok = F.col("near_n") >= ratio * F.col("n")
    held = held.select("word", F.when(ok, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("near_n")).alias("form_n"))
    out = held.join(roots(held.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
