"""Row numbers over a whole table, without a window that gathers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.sources.shared import materialize


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in this order (which must have no ties), from a range exchange and the partitions' sizes."""
    place = F.monotonically_increasing_id()
    rows = materialize(df.orderBy(*order).withColumn("at_", place), "numbered")
    part = F.shiftright("at_", 33)
    before, starts = 0, []
    for r in rows.groupBy(part.alias("part_")).agg(F.count("*").alias("n")).orderBy("part_").collect():  # one row a partition
        starts.append((r["part_"], before))
        before += r["n"]
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "part_ long, before_ long"))
    own = F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.withColumn("part_", part).join(starts, "part_").withColumn(name, F.col("before_") + own + 1)
    return out.drop("part_", "before_", "at_")
