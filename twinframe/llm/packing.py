"""Best-fit packing of tokenized documents into sequences (operator 2).

Two things make it scale. Tokenizing is one pass without a shuffle that keeps only the pieces'
lengths and checksums (and the ids, if asked for). Packing itself works on the histogram of piece
lengths, at most ``capacity`` numbers however large the corpus is: the plan is a list of bin
patterns with counts, made on the driver, and each piece finds its bin from its rank among the
pieces of its length. Ranks come from per-task counters and per-task offsets, so that no length,
however common, is ordered in one task.

The plan: pieces above a third of the capacity go at most two to a bin, and are matched greedily,
largest first, each with the largest partner that fits. Smaller ones, largest first, go to the
fullest bin that takes them; a new bin opens only when none does.

Edge cases. A null text is empty; an empty document is the end token alone. Rows with a null or
repeated id are documents like any other. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.slices import slices
from twinframe.sources.shared import materialize

END = 2


def plain(text: str) -> bool:
    """Whether a text holds only printable Latin-1 and line ends, without a run of white space that has
    a space in it: there, white space, letters and numbers mean the same to every regex library, and
    a cut before each space changes no token."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return text.replace("\n", "").isprintable() and not ("  " in text or " \n" in text or "\n " in text)


class Encoder:
    """Byte-level BPE ids as little-endian 32-bit bytes.

    A document is cut before each space and each part looked up; parts not seen yet go to a fast
    encoder built from the same file. Texts with unusual characters, special tokens or runs of white
    space go whole to the tokenizers library. The lookup tables hold about ``remember`` bytes at
    most and then start anew; parts of more than ``LONG`` characters are not kept.
    """

    LONG = 64
    #: Bytes of an entry beside its characters and ids, about.
    ENTRY = 150

    def __init__(self, path: str, remember: int = 48 << 20):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        byte = {c: b for b, c in names.items()}
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.remember, self.held, self.first, self.later = remember, 0, {}, {}

    def _part(self, table: dict, part: str, text: str) -> bytes:
        out = array("I", self.fast.encode_ordinary(text)).tobytes()
        if len(part) <= self.LONG:
            self.held += self.ENTRY + len(part) + len(out)
            if self.held > self.remember:
                self.first.clear(), self.later.clear()
                self.held = self.ENTRY + len(part) + len(out)
            table[part] = out
        return out

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not plain(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        head, *rest = text.split(" ")
        later, make = self.later, self._part
        got = list(map(later.get, rest))
        if None in got:
            got = [g or make(later, p, " " + p) for g, p in zip(got, rest, strict=True)]
        if head:
            got.insert(0, self.first.get(head) or make(self.first, head, head))
        return b"".join(got)


@cache
def encoder_of(path: str) -> Encoder:
    """A process's one encoder for a file: a worker keeps it from task to task."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole capacities after a first piece that may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(
    docs: DataFrame, path: str, capacity: int = 1024, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces ``(id_col, piece, start, length, ids_crc32, task, nth[, ids])``.

    ``task`` and ``nth`` place a piece among those of its length; they hold once the table is written.
    """
    src = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    fields = [
        T.StructField("id_", src.schema["id_"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, task, seen = encoder_of(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([END], dtype="<u4").tobytes()
        for b in (part for b in batches for part in slices(b, "text_", 2000)):
            row, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
            for i, text in enumerate(b.column("text_").to_pylist()):
                got = encoder.ids(text) + end
                for k, (s, n) in enumerate(cut(len(got) // 4, capacity)):
                    part = got[4 * s : 4 * (s + n)]
                    row.append(i), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(part)), nth.append(seen[n])
                    seen[n] += 1
                    if keep_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            cols = [
                b.column("id_").take(pa.array(row, type=pa.int64())), pa.array(piece, type=pa.int32()), pa.array(start, type=pa.int64()),
                pa.array(length, type=pa.int64()), pa.array(crc, type=pa.int64()), pa.array([task] * len(row), type=pa.int32()), pa.array(nth, type=pa.int64()),
            ]
            if keep_ids:
                cols.append(pa.array(ids, type=pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id_", id_col)


def plan_bins(sizes: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(piece lengths, number of such bins)``, placing exactly ``sizes[length]`` pieces of each length."""
    left = {s: n for s, n in sizes.items() if n}
    bins: dict[int, Counter] = {}  # room left -> patterns with that room

    def put(pattern: tuple[int, ...], n: int) -> None:
        bins.setdefault(capacity - sum(pattern), Counter())[pattern] += n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large.pop()
        n = left.pop(a)
        while n:
            if 2 * a <= capacity and n > 1:  # the largest partner that fits is of the same length
                put((a, a), n // 2)
                n %= 2
                continue
            at = bisect_left(large, capacity - a + 1)
            if not at:
                put((a,), n)
                break
            b = large[at - 1]
            k = min(n, left[b])
            put((a, b), k)
            n, left[b] = n - k, left[b] - k
            if not left[b]:
                del left[b], large[at - 1]
    rooms = sorted(bins)
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                pattern, have = bins[room].popitem()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, pattern, have = capacity, (), n
            each = min(room // s, n)
            full = min(have, n // each)
            for new, k in ((pattern + (s,) * each, full), (pattern, have - full if pattern else 0)):
                if k:
                    now = capacity - sum(new)
                    if now not in bins:
                        insort(rooms, now)
                    put(new, k)
            n -= each * full
    return [(p, n) for by in bins.values() for p, n in by.items()]


class Slots:
    """Where the r-th piece of a length goes."""

    SHIFT = 44

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        rows, filled, base = [], Counter(), 0
        for pattern, n in patterns:
            at = 0
            for s in pattern:
                rows.append(((s << self.SHIFT) + filled[s], base - filled[s], at))
                filled[s] += n
                at += s
            base += n
        rows.sort()
        self.key, self.shift, self.offset = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence numbers and offsets."""
        at = np.searchsorted(self.key, (length << self.SHIFT) + rank, side="right") - 1
        return rank + self.shift[at], self.offset[at]


def best_fit_pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """A written table of pieces with ``sequence_id`` and ``offset``; any other columns stay."""
    per = pieces.groupBy("task", "length").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(_window()) - F.col("n_")
    first = per.withColumn("before_", before).select("task", "length", "before_")
    sizes = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n_").alias("n")).collect()}  # at most ``capacity`` rows
    slots = Slots(plan_bins(sizes, capacity))
    ranked = pieces.join(first, ["task", "length"]).withColumn("rank_", F.col("before_") + F.col("nth")).drop("before_", "task", "nth")
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank_"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            seq, off = slots.place(b.column("length").to_numpy(), b.column("rank_").to_numpy())
            kept = [b.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], schema.names)

    return ranked.mapInArrow(run, schema)


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, keep_ids: bool = False, **cols) -> DataFrame:
    """Tokenize and pack: one row per piece with its sequence and offset."""
    return best_fit_pack(materialize(tokenize(docs, path, capacity, keep_ids, **cols), "pieces"), capacity)
