"""The set of items seen before: distinct hashes by item, and the parameters that they were made with."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.params import Params
from twinframe.sources.shared import discard, materialize
from twinframe.sources.versions import Conflict, Unreadable, Version, commit, current, read_table

log = logging.getLogger(__name__)

SCHEMA = "video_id string, hashes array<string>"
META = "num_frames int, hash_size int"
SUFFIXES = (".db", ".dat", ".bak")


def base_path(path: str) -> str:
    """The table's path, whichever known suffix was given."""
    return next((path[: -len(s)] for s in SUFFIXES if path.endswith(s)), path)


def read_watched(spark: SparkSession, path: str) -> tuple[DataFrame, dict | None]:
    """The items and their parameters, for look-ups; empty and None if there are none, or none that can be read (which is logged).

    Parameters that cannot be read are None and leave the items as they are.
    """
    path, nothing = base_path(path), spark.createDataFrame([], SCHEMA)
    try:
        version = current(spark, path)
        items = read_table(spark, version, "items", SCHEMA)
        items.agg(F.max(F.size("hashes"))).first()  # every file is read: a damaged one shows here
    except Exception:
        log.exception("the watched set %s cannot be read", path)
        return nothing, None
    try:
        return items, _parameters(spark, version)
    except Exception:
        log.exception("the parameters of the watched set %s cannot be read", path)
        return items, None


def _parameters(spark: SparkSession, version: Version) -> dict | None:
    meta = read_table(spark, version, "meta", META).first()
    return meta.asDict() if meta else None


def entries(signatures: DataFrame, words: int = 1) -> DataFrame:
    """``(video_id, hashes)`` of signatures: distinct frame hashes in hexadecimal, each of ``words`` 64-bit words."""
    each = F.transform("hashes", lambda h: F.lpad(F.lower(F.hex(h)), 16, "0"))
    frames = F.sequence(F.lit(1), F.size("hashes"), F.lit(words))
    hexes = each if words == 1 else F.transform(frames, lambda i: F.array_join(F.slice(each, i, words), ""))
    return signatures.filter(F.size("hashes") > 0).select(F.col("path").alias("video_id"), F.array_sort(F.array_distinct(hexes)).alias("hashes"))


def upsert_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(video_id, status, hashes)`` of the union: added, updated, refreshed or kept."""
    o = old.select("video_id", F.array_sort("hashes").alias("before"))
    n = new.select("video_id", F.array_sort("hashes").alias("after"))
    status = F.when(F.col("after").isNull(), "kept").when(F.col("before").isNull(), "added").when(F.col("before") == F.col("after"), "refreshed").otherwise("updated")
    return o.join(n, "video_id", "full").select("video_id", status.alias("status"), F.coalesce("after", "before").alias("hashes"))


def write_watched(spark: SparkSession, path: str, new: DataFrame, params: Params, tries: int = 10) -> dict[str, int]:
    """Upsert all of ``new`` in one write; other parameters than the table's are refused. Gives counts by status.

    A set that is there and cannot be read whole is an error (``Unreadable``) and stays as it is. Items and
    parameters are one commit. If another writer commits meanwhile, its items are merged with too. Entries
    without an id are left out; of several with one id the largest array counts.
    """
    path = base_path(path)
    new = new.filter("video_id is not null and video_id != ''").groupBy("video_id").agg(F.max("hashes").alias("hashes"))
    new = materialize(new, "watched-entries")
    for left in range(tries - 1, -1, -1):
        version = current(spark, path)
        meta = _parameters(spark, version)
        if meta and (meta["num_frames"], meta["hash_size"]) != (params.num_frames, params.hash_size):
            raise ValueError("the watched set was made with other parameters")
        merged = materialize(upsert_status(read_table(spark, version, "items", SCHEMA), new), "watched-merged")
        counts = {r["status"]: r["count"] for r in merged.groupBy("status").count().collect()}
        if (lost := version.rows("items") - sum(n for k, n in counts.items() if k != "added")) > 0:
            raise Unreadable(f"{path}: {lost} items are missing")
        try:
            commit({"items": merged.select("video_id", "hashes"), "meta": spark.createDataFrame([(params.num_frames, params.hash_size)], META).coalesce(1)}, path, version)
            discard(new)
            return counts
        except Conflict:
            log.info("the watched set %s was changed meanwhile, %d tries left", path, left)
        finally:
            discard(merged)
    raise Conflict(f"{path} was changed by others {tries} times")


def pool(watched: DataFrame, words: int = 1) -> DataFrame:
    """``(hash)``: the distinct frame hashes of all items, as longs; with more than one word, as arrays of longs."""
    part = [F.conv(F.substring("x", 16 * k + 1, 16), 16, -10).cast("bigint") for k in range(words)]
    return watched.select(F.explode("hashes").alias("x")).select((part[0] if words == 1 else F.array(*part)).alias("hash")).distinct()


def summary(watched: DataFrame, meta: dict | None) -> DataFrame:
    """One row: the number of items and the parameters, null if unknown."""
    m = meta or {}
    return watched.agg(F.count("*").alias("n_videos")).select("n_videos", F.lit(m.get("num_frames")).cast("int").alias("num_frames"), F.lit(m.get("hash_size")).cast("int").alias("hash_size"))
