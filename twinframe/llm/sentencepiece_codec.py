"""SentencePiece encoding and decoding with shared-prefix forward passes (operator 6).

A text becomes marked words: white space is written as the mark U+2581, and the text is cut before
each run of marks (no piece crosses such a place; that is checked when a model is loaded) and
around line ends. A batch's distinct words that were not seen before are sorted, which lays them
out as the depth-first walk of their trie: a word starts from the forward states of the prefix
that it shares with the word before it, and only the rest is computed. There is no shuffle.

The forward state depends on the model's type. For unigram models it is Viterbi's: the best score
of a segmentation of the prefix and its last piece. The ranks of a BPE model are not additive, and
maximizing their sum does not give the model's segmentation; there the state is the last piece of
the prefix's BPE segmentation. That is well defined, because a segmentation is BPE's exactly if
every two neighbours in it are what BPE makes of them, so of all pieces that end at a position one
goes with the state where it begins. Words that start with several marks, whose pieces tie in rank,
are merged step by step instead. All ways give the library's ids.

A task holds a part of a batch (500 texts or 4 MiB of text, one longer text alone) and the words
encoded so far, which are forgotten beyond ``remember`` bytes.

Edge cases. A null text is encoded as an empty one, which has no pieces. Unknown characters become
byte pieces if the model has them, else the unknown piece. Rows with null or repeated ids are kept;
extra columns are ignored; an empty table gives none. Decoding gives back every text without U+2581
whose characters the model's normalizer keeps.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.slices import slices

MARK = "▁"
#: Within this module a mark is a space.
WORDS = re.compile(" *[^ ]+| +")
UNIGRAM, BPE = 1, 2
#: What an entry of the table of words takes in Python beside its characters and ids, about.
ENTRY = 180


class Codec:
    """One model's pieces, and the words encoded so far, in about ``remember`` bytes and one part's words."""

    def __init__(self, path: str, remember: int = 192 << 20):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, self.kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a forward pass")
        self.plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        self.prefix = norm.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix
        usable = {1, 4} if self.kind == UNIGRAM else {1, 4, 5}  # normal, user-defined, unused (BPE merges through it)
        if any(p.type in (4, 5) for p in proto.pieces) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined or unused pieces and marks as suffixes are not supported")
        self.text = [p.piece.replace(MARK, " ") for p in proto.pieces]
        self.ids = {self.text[i]: i for i, p in enumerate(proto.pieces) if p.type in usable}
        self.score = [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece crosses the beginning of a marked word")
        self.longest = max(map(len, self.ids), default=1)
        self.line_ends = not any("\n" in p for p in self.ids)
        self.worst = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        if self.kind == BPE:
            whole = {p: self._merge(p) for p in self.ids}
            self.candidates = {p: i for p, i in self.ids.items() if whole[p][0] == [i]}
            for p, i in self.candidates.items():
                self.halves[i] = whole[p][1]
        else:
            self.candidates = self.ids
        self.remember, self.held, self.marked, self.whole = remember, 0, {}, {}
        self.end_of_line = array("i", self._unknown("\n")).tobytes()

    # BPE

    def _merge(self, word: str) -> tuple[list[int], tuple[int, int] | None]:
        """The segmentation by definition (best-ranked pair first, leftmost among equals; -1 - c for an unknown character c), and the last merge.

        Pairs wait in a heap, so a word of any length takes about as long as sorting its characters.
        """
        ids, score, n = self.ids, self.score, len(word)
        parts, after, before, last = list(word), list(range(1, n + 1)), list(range(-1, n - 1)), None
        heap: list[tuple] = []

        def meet(k: int) -> None:
            if 0 <= k and after[k] < n and (i := ids.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (-score[i], k, parts[k], parts[after[k]]))

        for k in range(n - 1):
            meet(k)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            j = after[k]
            if parts[k] != x or j >= n or parts[j] != y:  # one of the two is part of another by now
                continue
            last = (ids.get(x, -1), ids.get(y, -1))
            parts[k], parts[j], after[k] = x + y, "", after[j]
            if after[k] < n:
                before[after[k]] = k
            meet(before[k])
            meet(k)
        return [ids[p] if p in ids else -1 - ord(p) for p in parts if p], last

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether BPE leaves pieces a and b as they are when they stand side by side.

        The merges that made both are undone from the latest on, at the place where they meet; at
        each stage a pair across that place must not rank before the merge undone last.
        """
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[a, b] = self._merge(self.text[a] + self.text[b])[0] == [a, b] if self.tied(a) or self.tied(b) else self._apart(a, b)
        return got

    def tied(self, i: int) -> bool:
        return self.text[i].startswith("  ")

    def _apart(self, a: int, b: int) -> bool:
        score, text, ids, halves = self.score, self.text, self.ids, self.halves
        left, right, floor = a, b, -math.inf
        while True:
            across = ids.get(text[left] + text[right])
            if across is not None and score[across] > floor:
                return False
            x, y = halves.get(left), halves.get(right)
            if x is None and y is None:
                return True
            if y is None or x is not None and score[left] < score[right]:
                floor, left = score[left], x[1]  # an equal rank on the left comes first
            else:
                floor, right = math.nextafter(score[right], -math.inf), y[0]  # one on the right comes after

    # forward passes over sorted words

    def _unknown(self, c: str) -> list[int]:
        return [self.bytes[x] for x in c.encode()] if self.bytes else [self.unknown]

    def encode_sorted(self, words: list[str]):
        """``(word, ids)`` for sorted distinct words."""
        find, longest, bpe = self.candidates.get, self.longest, self.kind == BPE
        last, begin, best = [None], [0], [0.0]
        before = ""
        for w in words:
            if bpe and w.startswith("  "):
                out = []
                for i in self._merge(w)[0]:
                    out += [i] if i >= 0 else self._unknown(chr(-1 - i))
                yield w, out
                continue
            n, same = len(w), 0
            for x, y in zip(w, before, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], begin[same + 1 :], best[same + 1 :]
            for i in range(same + 1, n + 1):
                piece, at, top = -1, i - 1, float("-inf")
                if bpe:
                    for j in range(max(0, i - longest), i):
                        t = find(w[j:i])
                        if t is not None and (j == 0 or last[j] < 0 or self._neighbours(last[j], t)):
                            piece, at = t, j
                            break
                    last.append(piece), begin.append(at), best.append(0.0)
                else:
                    for j in range(max(0, i - longest), i):
                        t = find(w[j:i])
                        if t is not None and best[j] + self.score[t] > top:
                            piece, at, top = t, j, best[j] + self.score[t]
                    if w[i - 1] not in self.ids and best[i - 1] + self.worst > top:
                        piece, at, top = -1, i - 1, best[i - 1] + self.worst
                    last.append(piece), begin.append(at), best.append(top)
            before, out, i = w, [], n
            while i:
                out.append((last[i], begin[i], i))
                i = begin[i]
            yield w, [x for p, s, e in reversed(out) for x in ([p] if p >= 0 else self._unknown(w[s:e]))]

    # texts

    def normalize(self, text: str) -> str:
        """A text as the model sees it, with spaces for marks."""
        if not text:
            return ""
        if not self.plain:
            return self.library.normalize(text).replace(MARK, " ")
        return (" " if self.prefix else "") + text.replace(MARK, " ")

    def learn(self, marked: set[str], whole: set[str]) -> None:
        """Encode the words that aren't known: with a mark before them, or as they are."""
        if self.held > self.remember:
            self.marked.clear()
            self.whole.clear()
            self.held = 0
        new = {" " + w for w in marked if w not in self.marked} | {w for w in whole if w not in self.whole}
        for w, ids in self.encode_sorted(sorted(new)):
            got = array("i", ids).tobytes()
            self.held += ENTRY + len(w) + len(got)
            if w[0] == " " and w[1:] in marked:
                self.marked[w[1:]] = got
            if w in whole:
                self.whole[w] = got

    def encode(self, texts: list[str | None], at_once: int = 500) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit bytes."""
        out = []
        for k in range(0, len(texts), at_once):
            lines = [[self._cut(x) for x in (t.split("\n") if self.line_ends else [t])] if t else [] for t in map(self.normalize, (x or "" for x in texts[k : k + at_once]))]
            self.learn(set().union(*(m for t in lines for _, m in t)), set().union(*(w for t in lines for w, _ in t)))
            whole, marked = self.whole.__getitem__, self.marked.__getitem__
            out += [self.end_of_line.join([b"".join([*map(whole, w), *map(marked, m)]) for w, m in t]) for t in lines]
        return out

    @staticmethod
    def _cut(line: str) -> tuple[list[str], list[str]]:
        """A line's words: those to take whole, then those that follow a single mark."""
        head, *rest = line.split(" ")
        if "" in rest:  # several marks together, or one at the end
            return WORDS.findall(line), []
        return [head] if head else [], rest

    def decode(self, ids: bytes) -> str:
        """The text of a sequence of ids."""
        raw = self.raw
        out = b"".join([raw[i] for i in array("i", ids)]).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


def encode(docs: DataFrame, path: str, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_pieces, ids_crc32, round_trip[, ids])``; round_trip: decoding gave the text again."""
    src = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    fields = [T.StructField("id_", src.schema["id_"].dataType), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = Codec(path)
        for b in batches:
            for part in slices(b, "text_", 500):
                texts = part.column("text_").to_pylist()
                got = codec.encode(texts)
                same = [codec.decode(g) == (t or "") for g, t in zip(got, texts, strict=True)]
                cols = [part.column("id_"), pa.array([len(g) // 4 for g in got], type=pa.int64()), pa.array(map(zlib.crc32, got), type=pa.int64()), pa.array(same)]
                if keep_ids:
                    cols.append(pa.array([np.frombuffer(g, dtype="<i4") for g in got], type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id_", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns of ``encoded`` and the text of its ids (null for null)."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches):
        codec = Codec(path)
        for ids in batches:
            yield pd.Series([None if x is None else codec.decode(array("i", x).tobytes()) for x in ids], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return encoded.withColumn(text_col, F.pandas_udf(run, T.StringType())(F.col(ids_col)))
