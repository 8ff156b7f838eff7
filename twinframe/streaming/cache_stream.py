"""Keeping a signature cache up to date from a stream of file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from twinframe.params import Params
from twinframe.sources import cache, decode
from twinframe.sources.shared import discard, materialize
from twinframe.sources.versions import current, vacuum


def maintain_cache(files: DataFrame, path: str, params: Params, checkpoint: str, open_media=decode.VideoMedia, **trigger):
    """Start a query that hashes new and changed files of a stream ``(path, mtime, size_bytes)``; the upsert is idempotent."""

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        base = current(spark, path)
        known = cache.read_cache(spark, path, base)
        todo = cache.classify(batch.dropDuplicates(["path"]), known, params)
        done = materialize(decode.hash_files(todo.filter("class in ('miss', 'stale')"), params, open_media), "hashed")
        cache.write_changes(spark, path, base, cache.rows_of(done, params), done.limit(0))
        vacuum(spark, path)
        discard(done)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
