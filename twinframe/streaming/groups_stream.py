"""Groups of similar files kept up to date from a stream of listings.

The state is a stored table (``sources.versions``) of three: items with the item that stands for their
signature, these signatures, and the components of their pairs. A batch compares its new signatures with
each other and with the stored ones, and contracts the new pairs only. A file whose signature changed takes
pairs away, which no contraction can; then the components are made anew from the stored signatures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.operators.components import add_edges, connected_components
from twinframe.operators.similarity import pairs_between, similar_classes
from twinframe.params import Params
from twinframe.sources import decode
from twinframe.sources.shared import discard, materialize
from twinframe.sources.versions import commit, current, read_table, vacuum

ITEMS, REPS, COMPONENTS = "path string, rep string", "path string, hashes array<bigint>", "node string, component string"


def update(spark: SparkSession, path: str, signatures: DataFrame, params: Params) -> None:
    """Take in ``signatures(path, hashes)``; what is known already changes nothing, so a batch can be repeated."""
    base = current(spark, path)
    items, reps = (read_table(spark, base, t, s) for t, s in (("items", ITEMS), ("reps", REPS)))
    components = read_table(spark, base, "components", COMPONENTS)
    known = items.join(reps.withColumnRenamed("path", "rep"), "rep").select("path", F.col("hashes").alias("before"))
    batch = materialize(signatures.dropDuplicates(["path"]).join(known, "path", "left"), "batch-signatures")
    if not batch.filter("before is not null and before != hashes").isEmpty():
        whole = known.join(batch.select("path"), "path", "left_anti").withColumnRenamed("before", "hashes").unionByName(batch.select("path", "hashes"))
        classes, pairs = (materialize(x, "all") for x in similar_classes(materialize(whole, "all"), params))
        first = classes.filter("path = rep").join(whole, "path").select("path", "hashes")
        tables, keep = {"items": classes, "reps": first, "components": connected_components(pairs, "a", "b")}, {}
    else:
        fresh = batch.filter("before is null").select("path", "hashes")
        stored = reps.withColumnRenamed("path", "rep")
        same = fresh.join(stored, "hashes").select("path", "rep")
        classes, among = similar_classes(fresh.join(stored, "hashes", "left_anti"), params)
        classes, among = materialize(classes, "classes"), materialize(among.select("a", "b"), "pairs")
        first = materialize(classes.filter("path = rep").join(fresh, "path").select("path", "hashes"), "reps")
        edges = among.unionByName(pairs_between(first, reps, params).select("a", "b"))
        tables = {"items": same.unionByName(classes), "reps": first, "components": add_edges(components, materialize(edges, "edges"), "a", "b")}
        keep = {t: list(base.tables.get(t, {})) for t in ("items", "reps")}
    commit({t: materialize(df, t) for t, df in tables.items()}, path, base, keep)
    vacuum(spark, path)
    discard(batch)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """``(group_id, path)`` of the groups of two or more; the id is the first path."""
    now = current(spark, path)
    items, components = read_table(spark, now, "items", ITEMS), read_table(spark, now, "components", COMPONENTS)
    rows = items.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(F.coalesce("component", "rep").alias("group"), "path")
    groups = rows.groupBy("group").agg(F.min("path").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(groups, "group").select("group_id", "path")


def maintain_groups(files: DataFrame, path: str, params: Params, checkpoint: str, open_media=decode.VideoMedia, **trigger):
    """Start a query that hashes the files of a stream ``(path, mtime, size_bytes)`` and keeps the groups at ``path``."""

    def step(batch: DataFrame, _: int) -> None:
        done = materialize(decode.hash_files(batch.dropDuplicates(["path"]), params, open_media), "hashed")
        if not done.isEmpty():
            update(batch.sparkSession, path, done.filter("status = 'ok'").select("path", "hashes"), params)
        discard(done)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
