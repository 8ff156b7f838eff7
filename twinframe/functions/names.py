"""Names for columns that are added to tables of any columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores after it as make it differ from all columns of ``df`` (letter case does not count)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
