"""Groups of any size as pairs of bounded blocks.

A hot bucket, component or segment value is dealt into blocks by a hash of its members, and each
pair of blocks becomes one group for a Python task: every two members meet exactly in the group of
their two blocks, no task holds more than about two blocks, and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(entries: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """``entries`` of groups with two rows or more, each once for every block it must meet.

    Adds ``own`` (the row's block), ``lo`` and ``hi`` (the pair of blocks that names the group).
    """
    sizes = entries.groupBy(*keys).agg(F.count("*").alias("size_")).filter("size_ > 1")
    n = F.ceil(F.col("size_") / F.lit(float(block))).cast("int")
    dealt = entries.join(sizes, keys).withColumn("blocks_", n)
    own = F.pmod(F.xxhash64(member), F.col("blocks_")).cast("int")
    met = dealt.withColumn("own", own).withColumn("met_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
    return (
        met.withColumn("lo", F.least("own", "met_"))
        .withColumn("hi", F.greatest("own", "met_"))
        .drop("size_", "blocks_", "met_")
    )


def grouped(df: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """Rows of a group in one partition, one after another."""
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def columns(batch) -> dict[str, np.ndarray]:
    """A record batch's columns; binary ones of one width become a matrix of float64."""
    import pyarrow as pa

    out = {}
    for name, col in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_binary(col.type):
            out[name] = np.array(col.to_pylist(), dtype=object)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def whole_groups(batches, keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Key-sorted batches, cut so that each holds whole groups, and where its groups begin and the last one ends."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        if held is not None:
            now = {k: np.concatenate([held[k], now[k]]) for k in now}
        n = len(now[keys[0]])
        change = np.zeros(n - 1, dtype=bool)
        for k in keys:
            change |= now[k][1:] != now[k][:-1]
        cuts = np.flatnonzero(change) + 1
        if len(cuts):
            yield {k: v[: cuts[-1]] for k, v in now.items()}, np.concatenate(([0], cuts))
            now = {k: v[cuts[-1] :] for k, v in now.items()}
        held = now
    if held is not None:
        yield held, np.array([0, len(held[keys[0]])])


def runs(batches, keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of key-sorted batches; a group that crosses batches is put together."""
    for part, at in whole_groups(batches, keys):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield {k: v[a:b] for k, v in part.items()}


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: each row's component, as the smallest row index in it."""
    n = len(linked)
    label = np.full(n, -1, dtype=np.int64)
    for s in range(n):
        if label[s] >= 0:
            continue
        label[s] = s
        front = np.array([s])
        while len(front):
            near = linked[front].any(axis=0)
            front = np.flatnonzero(near & (label < 0))
            label[front] = s
    return label
