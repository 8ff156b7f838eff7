"""Bounded samples that do not sort whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest(df: DataFrame, by: Column, n: int) -> DataFrame:
    """About ``n`` rows, those with the smallest 64-bit hashes ``by``, and never more than ``2 * n``.

    Nothing is sorted: hashes are even, so the share of rows wanted is a bound on the hash. If copies
    leave none below it, any ``n`` rows serve.
    """
    total = df.count()
    if total <= n:
        return df
    edge = -(1 << 63) + int((1 << 64) * n / total)
    found = df.filter(by <= edge).limit(2 * n)
    return df.limit(n) if found.isEmpty() else found


def most_frequent(counts: DataFrame, n_col: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most ``most``: whole classes of counts, eighths of a power of two, from the top.

    Where the top class alone has more, about half of ``most`` of its rows are taken by their hash.
    """
    step = F.floor(F.log2(F.col(n_col).cast("double")) * 8)
    classes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()  # at most 512 rows
    left, edge = most, None
    for r in sorted(classes, key=lambda r: -r["step"]):
        left -= r["rows"]
        if left < 0:
            break
        edge = r["step"]
    if edge is None and classes:
        top = counts.filter(step == max(r["step"] for r in classes))
        return smallest(top, F.xxhash64(*counts.columns), max(1, most // 2))
    return counts.filter(step >= edge) if classes else counts.limit(0)
