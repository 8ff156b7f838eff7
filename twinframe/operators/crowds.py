"""Equi-joins on keys that very many rows of one side share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.sources.shared import materialize

#: Rows of the table side with one key, beyond which they are dealt into blocks.
CROWD = 4096


def dealt(table: DataFrame, probe: DataFrame, keys: list[str], crowd: int = CROWD) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi-join and its keys, so that about ``crowd`` rows of ``table`` at most have one.

    Rows of a crowded key are dealt into blocks by their hash, and the rows that ask for the key ask every
    block; the pairs that meet are the same. Without crowded keys both sides stay as they are.
    """
    sizes = table.groupBy(*keys).agg(F.count("*").alias("n_")).filter(F.col("n_") > crowd)
    sizes = materialize(sizes.select(*keys, F.ceil(F.col("n_") / F.lit(float(crowd))).cast("int").alias("n_")), "crowded")
    if sizes.isEmpty():
        return table, probe, keys
    blocks = F.coalesce("n_", F.lit(1))
    own = F.pmod(F.xxhash64(*(c for c in table.columns if c not in keys)), blocks).cast("int")
    table = table.join(sizes, keys, "left").withColumn("block", own).drop("n_")
    probe = probe.join(sizes, keys, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("n_")
    return table, probe, [*keys, "block"]
