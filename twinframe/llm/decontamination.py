"""Benchmark decontamination: passages of test items in training texts are found and removed (operator 11).

Texts and items are sequences of words: A-Z become a-z, and words are runs of 0-9, a-z and characters
beyond ASCII. A window is ``width`` consecutive words of an item; a shorter item is one window as a
whole. A set of the windows' hashes is broadcast, every window of every text is looked up in it in
Arrow batches, and what is met is verified on the words themselves, so hashes decide no result. A
text's words inside any occurrence are hit.

What is broadcast is bounded: windows of ``most_bytes`` of item text at most. A larger benchmark is a
table of windows instead. Then only a bitmap of fixed size is broadcast, which lets windows through
that may be in the table, and these are joined with it on the whole window.

Edge cases. A null or empty text has no words and no hits; an item without words has no windows. Rows
of the benchmark that repeat an id are one item with the windows of all of them; an item without an id
hits words, but is not named or counted among a text's items. Rows that repeat a document's id are
rows like others. Extra columns stay as they are, and where their names are those of new columns, the
new ones get underscores. Empty tables give no rows, or no hits. A very long text is scanned whole and
alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from twinframe.functions.names import free_name
from twinframe.llm.slices import slices
from twinframe.sources.shared import materialize

WIDTH = 10
#: Every byte to its word character, or to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_HITS = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
#: Words of an item in one piece, and bits of the bitmap for benchmarks that are joined.
PIECE, BITS = 4096, 27


class Words:
    """The words of several texts: the folded bytes, where words begin and end, their hashes and their texts."""

    def __init__(self, texts: list[bytes]):
        self.bytes = b" ".join(texts).translate(_FOLD) + b" " * 8
        raw = np.frombuffer(self.bytes, dtype=np.uint8)
        inside = np.zeros(len(raw) + 1, dtype=bool)
        np.not_equal(raw, 32, out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        ends_of_texts = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        self.owner = np.searchsorted(ends_of_texts, self.starts, side="right")
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        # A hash of a word's first and last eight bytes and its length.
        at = np.ndarray(max(0, len(raw) - 7), dtype="<u8", buffer=self.bytes, strides=(1,))
        size = self.ends - self.starts
        head = at[self.starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * np.clip(size, 1, 8)).astype(np.uint64))
        tail = np.where(size > 8, at[np.maximum(self.ends - 8, 0)], np.uint64(0))
        mixed = (head * _A) ^ ((tail + size.astype(np.uint64) * _C) * _B)
        self.hashes = (mixed ^ (mixed >> np.uint64(29))) * _C

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of this width, and which of them lie in one text."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        out = self.hashes[:n].copy()
        for j in range(1, width):
            out *= _B
            out += self.hashes[j : j + n]
        out ^= out >> np.uint64(31)
        out *= _A
        return out, self.owner[:n] == self.owner[width - 1 : width - 1 + n]

    def text(self, first: int, width: int) -> bytes:
        return b" ".join(self.bytes[self.starts[first] : self.ends[first + width - 1]].split())


class Table:
    """Windows of one width: hashes in order, where each occurs in the items, and a bitmap of them."""

    def __init__(self, pieces: list[bytes], items: list[int], width: int):
        words = Words(pieces)
        hashes, whole = words.windows(width)
        at = np.flatnonzero(whole)
        at = at[np.argsort(hashes[at], kind="stable")]
        self.width, self.bytes = width, words.bytes
        self.start, self.end = words.starts[at], words.ends[at + width - 1]
        self.item = np.asarray(items, dtype=np.int64)[words.owner[at]]
        self.hashes, first = np.unique(hashes[at], return_index=True)
        self.first = np.append(first, len(at))
        self.shift = np.uint64(64 - min(26, max(10, int(16 * len(self.hashes)).bit_length())))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.bitmap[self.hashes >> self.shift] = True
        self._known: dict[int, list[tuple[bytes, set[int]]]] = {}

    def met(self, words: Words) -> Iterator[tuple[int, set[int]]]:
        """The first word of each occurrence of a window, and the items that have it."""
        hashes, whole = words.windows(self.width)
        maybe = np.flatnonzero(self.bitmap[hashes >> self.shift] & whole)
        rank = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[rank] == hashes[maybe]
        for i, r in zip(maybe[same].tolist(), rank[same].tolist(), strict=True):
            text = words.text(i, self.width)
            for window, items in self._of(r):
                if window == text:
                    yield i, items

    def _of(self, rank: int) -> list[tuple[bytes, set[int]]]:
        if rank not in self._known:
            found: dict[bytes, set[int]] = {}
            for k in range(self.first[rank], self.first[rank + 1]):
                found.setdefault(b" ".join(self.bytes[self.start[k] : self.end[k]].split()), set()).add(int(self.item[k]))
            self._known[rank] = list(found.items())
        return self._known[rank]


def _pieces(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(item, width, piece)``: folded item texts; long ones in pieces that share ``width - 1`` words, so every window is in one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, "text", 256):
                out: list[tuple] = []
                for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                    words = text.translate(_FOLD).split() if text else []
                    k = min(width, len(words))
                    out += [(item, k, b" ".join(words[i : i + PIECE + k - 1])) for i in range(0, len(words) - k + 1, PIECE) if k]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.string(), pa.int32(), pa.binary()), strict=True)], ["item", "width", "piece"])

    src = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "item string, width int, piece binary").distinct()


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
    return [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scan(docs: DataFrame, tables, kept: list[str], text_col: str, names: list[str]) -> DataFrame:
    """The ``kept`` columns with the number of words, hit spans and items of each row; ``tables`` is a broadcast of items and tables."""
    src = docs.withColumn(free_name(docs, "bytes_"), F.col(text_col).cast("binary"))
    at = src.columns[-1]

    def run(batches):
        import pyarrow as pa

        ids, found = tables.value
        for batch in batches:
            for b in slices(batch, at, 4096, 2 << 20):
                words = Words([t or b"" for t in b.column(at).to_pylist()])
                edge, items = np.zeros(len(words.starts) + 1, dtype=np.int32), [set() for _ in range(b.num_rows)]
                for table in found:
                    for i, own in table.met(words):
                        edge[i] += 1
                        edge[i + table.width] -= 1
                        items[words.owner[i]] |= own
                hit = np.cumsum(edge[:-1]) > 0
                first = words.first.tolist()
                spans = [_spans(hit[a:z]) if own else [] for a, z, own in zip(first[:-1], first[1:], items, strict=True)]
                own = [sorted({ids[k] for k in s if ids[k] is not None}) for s in items]
                new = [pa.array(np.diff(words.first), type=pa.int64()), pa.array(spans, type=to_arrow_type(T.ArrayType(_HITS))), pa.array(own, type=pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + new, [*kept, *names])

    return src.mapInArrow(run, _schema(docs.select(*kept), names))


def _schema(docs: DataFrame, names: list[str]) -> T.StructType:
    kinds = (T.LongType(), T.ArrayType(_HITS), T.ArrayType(T.StringType()))
    return T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])


def _joined(docs: DataFrame, pieces: DataFrame, kept: list[str], text_col: str, names: list[str]) -> DataFrame:
    """The same for a benchmark of any size: windows that pass a bitmap are joined with the table of windows."""
    spark = docs.sparkSession
    widths = sorted(r["width"] for r in pieces.select("width").distinct().collect())  # as many as a window has words
    shift = np.uint64(64 - BITS)

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for item, k, piece in zip(*(b.column(c).to_pylist() for c in ("item", "width", "piece")), strict=True):
                words = Words([piece])
                texts = [words.text(i, k) for i in range(len(words.starts) - k + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(texts), type=pa.string()), pa.array(texts, type=pa.binary())], ["item", "window"])

    def bits(rows):
        out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
        for k, piece in rows:
            at = Words([bytes(piece)]).windows(k)[0] >> shift
            np.bitwise_or.at(out, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        yield out

    windows = pieces.mapInArrow(cut, "item string, window binary").distinct()
    bitmap = spark.sparkContext.broadcast(pieces.select("width", "piece").rdd.mapPartitions(bits).treeReduce(np.bitwise_or))
    d1, d2, raw, at = (free_name(docs, x) for x in ("key1_", "key2_", "bytes_", "places_"))
    # Rows of the same text have the same hits.
    keyed = docs.withColumns({d1: F.xxhash64(F.col(text_col)), d2: F.xxhash64(F.lit(3), F.col(text_col)), raw: F.col(text_col).cast("binary")})

    def maybe(batches):
        import pyarrow as pa

        known = bitmap.value
        for batch in batches:
            for b in slices(batch, "bytes", 4096, 2 << 20):
                words, out = Words([t or b"" for t in b.column("bytes").to_pylist()]), []
                k1, k2 = b.column("d1").to_pylist(), b.column("d2").to_pylist()
                for k in widths:
                    h, whole = words.windows(k)
                    h >>= shift
                    own = np.flatnonzero((known[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & whole)
                    for i in own.tolist():
                        w = words.owner[i]
                        out.append((k1[w], k2[w], int(i - words.first[w]), k, words.text(i, k)))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["d1", "d2", "pos", "k", "window"])

    texts = keyed.select(F.col(d1).alias("d1"), F.col(d2).alias("d2"), F.col(raw).alias("bytes"))
    met = texts.mapInArrow(maybe, "d1 bigint, d2 bigint, pos int, k int, window binary").distinct().join(windows, "window")
    met = materialize(met.select("d1", "d2", "pos", "k", "item"), "window-hits")
    places = met.select("d1", "d2", F.explode(F.sequence("pos", F.col("pos") + F.col("k") - 1)).alias("at")).distinct()
    places = places.groupBy("d1", "d2").agg(F.array_sort(F.collect_list("at")).alias("at"))  # of one text
    own = met.groupBy("d1", "d2").agg(F.array_sort(F.collect_set("item")).alias("items"))  # nulls are left out
    found = places.join(own, ["d1", "d2"]).withColumnsRenamed({"d1": d1 + "_", "d2": d2 + "_", "at": at, "items": names[2]})
    rows = keyed.join(found, (F.col(d1) == F.col(d1 + "_")) & (F.col(d2) == F.col(d2 + "_")), "left").select(*kept, raw, at, names[2])

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, raw, 4096, 2 << 20):
                n = np.diff(Words([t or b"" for t in b.column(raw).to_pylist()]).first)
                spans = []
                for x in b.column(at).to_pylist():
                    x = np.asarray(x or [], dtype=np.int64)
                    cuts = np.flatnonzero(np.diff(x) > 1) + 1
                    spans.append([{"start": int(p[0]), "end": int(p[-1]) + 1} for p in np.split(x, cuts) if len(p)])
                own = [x or [] for x in b.column(names[2]).to_pylist()]
                new = [pa.array(n, type=pa.int64()), pa.array(spans, type=to_arrow_type(T.ArrayType(_HITS))), pa.array(own, type=pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + new, [*kept, *names])

    return rows.mapInArrow(finish, _schema(docs.select(*kept), names))


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most_bytes: int = 8 << 20, id_col: str = "item_id", text_col: str = "text", names=("n_words", "hit_spans", "items"), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns) with the number of words, the spans ``(start, end)`` of words that are hit, and the sorted ids of the items met.

    ``id_col`` is the benchmark's; both tables have their texts in ``text_col``.
    """
    kept, named, out = docs.columns if keep is None else keep, docs, []
    for n in names:
        out.append(free_name(named, n))
        named = named.withColumn(out[-1], F.lit(0))
    pieces = materialize(_pieces(benchmark, width, id_col, text_col), "benchmark-pieces")
    if (pieces.agg(F.sum(F.length("piece"))).first()[0] or 0) > most_bytes:
        return _joined(docs, pieces, kept, text_col, out)
    rows = pieces.collect()  # most_bytes at most
    ids = list(dict.fromkeys(r["item"] for r in rows))
    number = {x: i for i, x in enumerate(ids)}
    tables = []
    for k in sorted({r["width"] for r in rows}):
        own = [r for r in rows if r["width"] == k]
        tables.append(Table([bytes(r["piece"]) for r in own], [number[r["item"]] for r in own], k))
    return _scan(docs, docs.sparkSession.sparkContext.broadcast((ids, tables)), kept, text_col, out)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join([*out, text[done:]])


#: Words before A-Z are folded.
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", share: float = 0.0, width: int = WIDTH, most_bytes: int = 8 << 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``docs`` without what is hit: ``remove`` is "spans" (of words, and what stands between them) or "documents".

    Documents go where more than ``share`` of their words are hit; the columns stay the same.
    """
    found = find_hits(docs, benchmark, width, most_bytes, id_col, text_col, ("n_words_", "hit_spans_", "items_"))
    n, spans, _ = found.columns[len(docs.columns) :]
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    if remove == "documents":
        return found.filter(hit <= F.lit(share) * F.col(n)).select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'spans' or 'documents'")
    kept = docs.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [cut_spans(t, [(s["start"], s["end"]) for s in x]) if x else t for t, x in zip(b.column(text_col).to_pylist(), b.column(spans).to_pylist(), strict=True)]
            new = pa.array(texts, type=b.column(text_col).type)
            yield pa.RecordBatch.from_arrays([new if c == text_col else b.column(c) for c in kept], kept)

    return found.mapInArrow(run, docs.schema)
