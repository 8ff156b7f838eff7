"""Frame hashes and their distances as column expressions.

A signature is an array of longs: ``words`` longs for each frame, in frame order. With 64 bits a
frame or fewer that is one long a frame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_indices(total, k: int) -> Column:
    """``k`` frame numbers spread evenly over ``total`` frames; the first alone if k is 1."""
    last = F.greatest(total - 1, F.lit(0))
    if k == 1:
        return F.array(F.lit(0))
    step = last.cast("double") / F.lit(float(k - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == k - 1, last).otherwise(F.floor(i * step)).cast("int"))


def average_hash(values, bits: int) -> Column:
    """Bits ``value > mean`` of a frame's numbers, first number first, as longs of 64 bits (the last may be shorter)."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    one = lambda s, at: F.aggregate(
        F.slice(s["v"], at + 1, min(64, bits - at)), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > s["m"], F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    )
    # The frame goes through a one-element array, so that its mean is computed once and not for each number.
    both = F.array(F.struct(values.alias("v"), mean.alias("m")))
    return F.transform(both, lambda s: F.array(*[one(s, at) for at in range(0, bits, 64)]))[0]


def hamming(a, b) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def total_distance(a, b, words: int) -> Column:
    """Summed distance of two signatures given as lists of ``words`` columns (unrolled, so that it stays in generated code)."""
    return sum((hamming(a[i], b[i]) for i in range(1, words)), hamming(a[0], b[0]))


def similarity(total, frames, bits: int) -> Column:
    """Per cent, in this order of double operations."""
    b = F.lit(float(bits))
    return F.greatest(F.lit(0.0), (b - total.cast("double") / frames) / b) * 100.0


def similarity_of(total: int, frames: int, bits: int) -> float:
    return max(0.0, (float(bits) - total / frames) / bits) * 100


def aligned_similarity(a, b, bits: int) -> Column:
    """Similarity of two arrays of frame hashes (64 bits or fewer); 0 if empty or of different lengths, a null hash is all bits apart."""
    far = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.coalesce(hamming(p["x"], p["y"]), F.lit(bits)))
    total = F.aggregate(far, F.lit(0), lambda s, d: s + d)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | a.isNull() | b.isNull(), F.lit(0.0)).otherwise(similarity(total, F.size(a), bits))


def widest(threshold: float, frames: int, bits: int) -> int:
    """The largest summed distance that is still similar; -1 if none is."""
    if threshold <= 0:
        return frames * bits
    lo, hi = -1, frames * bits
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if similarity_of(mid, frames, bits) >= threshold else (lo, mid - 1)
    return lo


def candidate_radius(threshold: float, bits: int) -> int:
    return int(bits * (1 - threshold / 100.0)) + 1


def to_hex(h, bits: int = 64) -> Column:
    return F.lpad(F.lower(F.hex(h)), max(1, -(-bits // 4)), "0")


def from_hex(s) -> Column:
    return F.conv(s, 16, -10).cast("bigint")
