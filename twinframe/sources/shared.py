"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage here: a table that is written can be read again after
executors are lost, and is not computed twice. The folder is the one that the cluster names in
``spark.checkpoint.dir``; where that is unset a temporary one is made if, and only if, the session
runs in one process (tests, a laptop).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

#: Tables of this process that were written and not deleted yet, in order.
_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder's path; an error on a cluster that names none."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="twinframe-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str = "table", rows: int | None = None, each: int = 50_000) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    Where the caller knows a bound on its rows, there is at most a task, and so a file, for every
    ``each`` of them: a small table is not left in as many files as the shuffle has partitions.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder for files that a caller writes itself; ``sweep()`` deletes it."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_shared_path", None):
            _delete(df.sparkSession, path)


def mark(spark: SparkSession) -> int:
    """A place in the order of tables written; see sweep()."""
    return len(_written)


def sweep(spark: SparkSession, since: int = 0) -> int:
    """Delete what this process wrote after ``mark()``, once the results that read it are stored; the number of tables deleted."""
    paths = _written[since:]
    for p in paths:
        _delete(spark, p)
    return len(paths)
