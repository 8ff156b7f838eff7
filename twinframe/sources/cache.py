"""The signature cache: what was hashed already, by path, valid while mtime and parameters match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.params import Params
from twinframe.sources.shared import discard, materialize
from twinframe.sources.versions import Version, commit, current, read_table

#: Parts of a stored cache, by a hash of the path: what changes decides which of them are written anew.
BUCKETS = 64
SCHEMA = "path string, status string, hashes array<bigint>, mtime double, num_frames int, hash_size int"


def read_cache(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """A version of the cache, the current one by default; empty if there is none, ``Unreadable`` if it cannot be read."""
    return read_table(spark, version or current(spark, path), "table", SCHEMA)


def classify(files: DataFrame, cache: DataFrame, params: Params) -> DataFrame:
    """``files`` with ``class`` (hit, skipped, stale, miss) and the hashes of hits."""
    c = cache.select("path", F.struct("status", "hashes", "mtime", "num_frames", "hash_size").alias("c"))
    same = F.col("c.mtime").eqNullSafe(F.col("mtime")) & F.col("c.num_frames").eqNullSafe(F.lit(params.num_frames)) & F.col("c.hash_size").eqNullSafe(F.lit(params.hash_size))
    kind = (
        F.when(F.col("c").isNull(), "miss").when(same & (F.col("c.status") == "SKIPPED"), "skipped")
        .when(same & (F.col("c.status") == "OK") & F.col("c.hashes").isNotNull(), "hit").otherwise("stale")
    )
    return files.join(c, "path", "left").withColumn("class", kind).withColumn("hashes", F.when(F.col("class") == "hit", F.col("c.hashes"))).drop("c")


def stats(classified: DataFrame) -> DataFrame:
    """One row: hits, misses, stale, skipped."""
    n = lambda x: F.count_if(F.col("class") == x)
    return classified.agg(n("hit").alias("hits"), n("miss").alias("misses"), n("stale").alias("stale"), n("skipped").alias("skipped"))


def prune(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of files that are still listed."""
    return cache.join(files.select("path"), "path", "left_semi")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the rows of ``new`` (one a path) in place of older ones."""
    return cache.join(new.select("path"), "path", "left_anti").unionByName(new.select(*cache.columns))


def rows_of(results: DataFrame, params: Params) -> DataFrame:
    """Cache rows of decoding results ``(path, mtime, status, hashes)``; vanished files leave none."""
    ok = F.col("status") == "ok"
    return results.filter("status != 'vanished'").select(
        "path", F.when(ok, "OK").otherwise("SKIPPED").alias("status"), F.when(ok, F.col("hashes")).alias("hashes"), "mtime", F.lit(params.num_frames).alias("num_frames"), F.lit(params.hash_size).alias("hash_size")
    )


def _bucket() -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")


def write_cache(df: DataFrame, path: str, base: Version | None = None) -> Version:
    """Make ``df`` the whole cache; with ``base``, the version it was made from, another writer's work is not undone (``Conflict``)."""
    rows = df.withColumn("bucket", _bucket())
    return commit({"table": rows.repartition("bucket")}, path, base or current(df.sparkSession, path), by="bucket")


def write_changes(spark: SparkSession, path: str, base: Version, new: DataFrame, gone: DataFrame) -> Version:
    """The version after ``base`` with the rows of ``new`` (one a path) in place of older ones, and without the paths ``gone``.

    Only buckets that have such paths are read and written; the others' files stay. Without any, nothing is written.
    """
    new = materialize(new.withColumn("bucket", _bucket()), "cache-changes")
    gone = materialize(gone.select("path").withColumn("bucket", _bucket()), "cache-gone")
    touched = [str(r[0]) for r in new.select("bucket").union(gone.select("bucket")).distinct().collect()]  # BUCKETS at most
    if touched:
        old = read_table(spark, base, "table", SCHEMA, touched)
        merged = upsert(old.join(gone, "path", "left_anti"), new).withColumn("bucket", _bucket())
        keep = [p for p in base.tables.get("table", {}) if p not in touched]
        base = commit({"table": merged.repartition("bucket")}, path, base, {"table": keep}, "bucket")
    discard(new, gone)
    return base
