"""Close pairs of signatures within one task, in numpy: the signatures of two blocks, tile by tile.

A pair is looked at first by a sketch: words are folded by exclusive or into so few that unrelated ones
still differ in more bits than may differ. Folding never makes a distance larger, so no close pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np

#: Pairs that are looked at together: rows of either side of a tile (within a core's cache), and candidates of an index.
TILE, MANY = (32, 4096), 1 << 18
#: Pairs found that are given on together.
OUT = 1 << 16
#: Bits of a band of an index at most.
WIDE = 20


class Close:
    """Pairs at a distance of ``most`` bits or less of signatures of ``n`` words, ``word_bits`` of each in use; ``indexed`` by bands or all compared."""

    def __init__(self, n: int, most: int, word_bits: int = 64, indexed: bool = False):
        self.n, self.most, self.per = n, most, max(1, 64 // word_bits)
        self.words = -(-n // self.per)
        self.bits, self.shift = word_bits, word_bits
        self.folded = next((k for k in range(1, self.words) if 32 * k - most > 13 * sqrt(k)), self.words)
        self.bands = self._bands() if indexed else None

    def _bands(self) -> list[tuple[int, int, int]] | None:
        """Each band's first bit, width and radius (0 or 1); the radii plus one add up to ``most`` + 1. None if that takes bands of less than two bits."""
        total = 64 * self.words
        m = max(ceil((self.most + 1) / 2), ceil(total / WIDE))
        if 2 * m > total:
            return None
        edges = [total * i // m for i in range(m + 1)]
        share, more = divmod(self.most + 1, m)
        radii = [share - 1 + (i < more) for i in range(m)]
        return [(a, b - a, r) for a, b, r in zip(edges[:-1], edges[1:], radii, strict=True) if r >= 0]

    def packed(self, h: np.ndarray) -> np.ndarray:
        """Signatures of short words as fewer full ones, with the same distances."""
        if self.per == 1:
            return h
        out = np.zeros((len(h), self.words), dtype=np.uint64)
        low = np.uint64((1 << self.bits) - 1)
        for i in range(self.n):
            out[:, i // self.per] |= (h[:, i] & low) << np.uint64(self.shift * (i % self.per))
        return out

    def sketch(self, h: np.ndarray) -> np.ndarray:
        """A row for each of the words that are left."""
        return np.stack([np.bitwise_xor.reduce(h[:, i :: self.folded], axis=1) for i in range(self.folded)])

    def pairs(self, a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in ``a`` and ``b`` and distances of close pairs; each pair once where both are the same rows."""
        if self.most < 0:
            return
        a, b = self.packed(a), self.packed(b)
        for i, j in together(self._indexed(a, b) if self.bands else self._tiles(a, b, same), OUT):
            if same:
                i, j = i[i < j], j[i < j]
            far = np.zeros(len(i), dtype=np.int32)
            for w in range(self.words):
                far += np.bitwise_count(a[i, w] ^ b[j, w])
            near = far <= self.most
            i, j, far = i[near], j[near], far[near]
            if len(i):
                yield i, j, far

    def _tiles(self, a, b, same):
        """Pairs whose sketches are close, of rows whose numbers of ones are: those differ in no more than the distance."""
        ones = [np.bitwise_count(x).sum(axis=1, dtype=np.int32) for x in (a, b)]
        oa, ob = (np.argsort(x, kind="stable") for x in ones)
        na, nb = ones[0][oa], ones[1][ob]
        sa, sb = self.sketch(a[oa]), self.sketch(b[ob])
        # Sums of bytes are modulo 256: that hides no pair that is close.
        kind = np.uint8 if self.most < 256 else np.int32
        diff, far, n = np.empty(TILE, np.uint64), np.empty(TILE, kind), np.empty(TILE, np.uint8)
        for p in range(0, len(a), TILE[0]):
            x = sa[:, p : p + TILE[0], None]
            k = x.shape[1]
            begin = np.searchsorted(nb, na[p] - self.most)
            end = np.searchsorted(nb, na[p + k - 1] + self.most, side="right")
            for q in range(max(begin, p) if same else begin, end, TILE[1]):
                y = sb[:, None, q : min(q + TILE[1], end)]
                at = slice(k), slice(y.shape[2])
                d, f, c = diff[at], far[at], n[at]
                np.bitwise_count(np.bitwise_xor(x[0], y[0], out=d), out=f if kind is np.uint8 else c)
                if kind is not np.uint8:
                    f[:] = c
                for w in range(1, self.folded):
                    np.add(f, np.bitwise_count(np.bitwise_xor(x[w], y[w], out=d), out=c), out=f)
                flat = np.flatnonzero(f <= self.most)  # much faster than nonzero of a matrix
                if len(flat):
                    i, j = np.divmod(flat, y.shape[2])
                    i, j = i + p, j + q
                    if same:
                        i, j = oa[i[i < j]], oa[j[i < j]]
                        yield np.minimum(i, j), np.maximum(i, j)
                    else:
                        yield oa[i], ob[j]

    def _value(self, h: np.ndarray, band: tuple[int, int, int]) -> np.ndarray:
        at, width, _ = band
        word, low = divmod(at, 64)
        out = h[:, word] >> np.uint64(low)
        if low + width > 64:
            out = out | h[:, word + 1] << np.uint64(64 - low)
        return out & np.uint64((1 << width) - 1)

    def _indexed(self, a, b):
        """Pairs whose sketches are close and that agree in a band, from the first such band only."""
        sa, sb = np.ascontiguousarray(self.sketch(a).T), np.ascontiguousarray(self.sketch(b).T)
        for k, band in enumerate(self.bands):
            va, vb = self._value(a, band).astype(np.int64), self._value(b, band).astype(np.int64)
            order = np.argsort(vb, kind="stable")
            starts = np.concatenate(([0], np.cumsum(np.bincount(vb, minlength=1 << band[1]))))
            for mask in [0, *(1 << x for x in range(band[1] if band[2] else 0))]:
                first = starts[va ^ mask]
                for i, at in spans(starts[(va ^ mask) + 1] - first, MANY):
                    j = order[first[i] + at]
                    diff = np.bitwise_count(sa[i] ^ sb[j])
                    far = diff[:, 0].astype(np.int32)
                    for w in range(1, self.folded):
                        far += diff[:, w]
                    near = np.flatnonzero(far <= self.most)
                    if len(near):
                        i, j = i[near], j[near]
                        new = np.ones(len(i), dtype=bool)
                        for before in self.bands[:k]:
                            new &= np.bitwise_count(self._value(a[i] ^ b[j], before)) > before[2]
                        yield i[new], j[new]


def together(parts: Iterator[tuple[np.ndarray, ...]], many: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Small parts put together, until they have ``many`` rows or more."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= many:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def spans(n: np.ndarray, many: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every place ``i`` of ``n``, ``n[i]`` times, with the numbers from 0 to ``n[i]`` - 1; ``many`` of them together."""
    ends = np.cumsum(n, dtype=np.int64)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, many):
        hi = min(lo + many, int(ends[-1]))
        # The places whose numbers lie between lo and hi, and how many of each do.
        r0, r1 = np.searchsorted(ends, (lo, hi - 1), side="right")
        own = slice(r0, r1 + 1)
        m = np.minimum(ends[own], hi) - np.maximum(ends[own] - n[own], lo)
        yield np.repeat(np.arange(r0, r1 + 1), m), np.arange(lo, hi) - np.repeat(ends[own] - n[own], m)


class Copies:
    """Rows of signatures by classes of equal ones."""

    def __init__(self, h: np.ndarray):
        whole = np.ascontiguousarray(h).view(np.dtype((np.void, h.dtype.itemsize * h.shape[1]))).ravel()
        _, self.first, of, self.n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        self.rows, self.start = np.argsort(of, kind="stable"), np.cumsum(self.n) - self.n

    def within(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of copies, as rows."""
        after = np.repeat(self.start + self.n, self.n) - np.arange(len(self.rows)) - 1
        for i, k in spans(after, OUT):
            yield self.rows[i], self.rows[i + 1 + k]

    def between(self, others: Copies, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The rows of pairs ``(i, j)`` of classes, and each one's place among these."""
        for at, k in spans(self.n[i].astype(np.int64) * others.n[j], OUT):
            x, y = np.divmod(k, others.n[j[at]])
            yield self.rows[self.start[i[at]] + x], others.rows[others.start[j[at]] + y], at


def close_rows(close: Close, a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distances as ``close.pairs`` gives them in any order; copies are compared once."""
    ca = Copies(a)
    cb = ca if same else Copies(b)
    if same and close.most >= 0:
        for i, j in ca.within():
            yield i, j, np.zeros(len(i), dtype=np.int32)
    for i, j, far in close.pairs(a[ca.first], b[cb.first], same):
        for x, y, at in ca.between(cb, i, j):
            yield x, y, far[at]


def dealt_pairs(close: Close, blocks: int) -> Callable:
    """A function for ``mapInArrow`` over ``(path, h, own, pair)``, sorted by pair (lo * blocks + hi): close pairs of the rows of each pair of blocks."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []

        def compared():
            h, own = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
            paths = pa.concat_arrays([x[0] for x in held])
            held.clear()
            lo, hi = np.flatnonzero(own == at // blocks), np.flatnonzero(own == at % blocks)
            same = at // blocks == at % blocks
            for i, j, far in together(close_rows(close, h[lo], h[hi], same), OUT):
                yield pa.RecordBatch.from_arrays([paths.take(pa.array(lo[i])), paths.take(pa.array(hi[j])), pa.array(far.astype(np.int32))], ["a", "b", "total"])

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            pair = batch.column("pair").to_numpy()
            h = batch.column("h").flatten().to_numpy().reshape(-1, close.n).view(np.uint64)
            own = batch.column("own").to_numpy()
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and pair[x] != at:
                    yield from compared()
                at = int(pair[x])
                held.append((batch.column("path")[x:y], h[x:y], own[x:y]))
        if held:
            yield from compared()

    return run


def nearest_in(words: int) -> Callable:
    """A function for ``mapInArrow`` over ``(h, asks, pair)``, sorted by pair: every asking hash of a pair of blocks with its smallest distance to the others."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def compared():
            h, asks = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = h[asks], h[~asks]
            if not len(a) or not len(b):
                return
            far = np.full(len(a), 64 * words, dtype=np.int32)
            for p in range(0, len(a), TILE[0]):
                for q in range(0, len(b), TILE[1]):
                    total = sum(np.bitwise_count(a[p : p + TILE[0], None, w] ^ b[None, q : q + TILE[1], w]).astype(np.uint8 if words < 4 else np.int32) for w in range(words))
                    np.minimum(far[p : p + TILE[0]], total.min(axis=1), out=far[p : p + TILE[0]])
            at = pa.array(np.arange(len(a) + 1, dtype=np.int32) * words)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(a.ravel().view(np.int64))), pa.array(far)], ["h", "met"])

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            pair = batch.column("pair").to_numpy()
            h = batch.column("h").flatten().to_numpy().reshape(-1, words).view(np.uint64)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and pair[x] != at:
                    yield from compared()
                    held.clear()
                at = int(pair[x])
                held.append((h[x:y], asks[x:y]))
        if held:
            yield from compared()

    return run
