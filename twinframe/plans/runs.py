"""Whole runs: hash a folder, find similar files, keep a watched set. Prompts are parameters here."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.operators.groups import group_members, group_report, group_scores, totals
from twinframe.operators.moves import apply_moves, move_plan, resume_moves
from twinframe.operators.similarity import similar_classes
from twinframe.operators.watched import split_watched
from twinframe.params import CACHE_NAME, RESERVED_FOLDERS, Params
from twinframe.sources import cache, decode, watched
from twinframe.sources.listing import cache_path, list_media
from twinframe.sources.shared import materialize
from twinframe.sources.versions import Unreadable, Version, current, last_number, vacuum

log = logging.getLogger(__name__)


def hash_folder(spark: SparkSession, folder: str, params: Params, recursive: bool = False, cache_name: str | None = None, open_media=decode.VideoMedia) -> tuple[DataFrame, DataFrame]:
    """``signatures(path, hashes)`` and ``skipped(path, reason)``; what is cached is not hashed again."""
    files = materialize(list_media(spark, folder, recursive), "files")
    at = cache_path(folder, cache_name or CACHE_NAME)
    try:
        base = current(spark, at)
        stored = cache.read_cache(spark, at, base)
    except Unreadable:  # costs time and no more; it is replaced
        log.exception("the cache %s cannot be read", at)
        base, stored = None, spark.createDataFrame([], cache.SCHEMA)
    known = materialize(cache.prune(stored, files), "known")
    classified = materialize(cache.classify(files, known, params), "classified")
    todo = classified.filter(F.col("class").isin("miss", "stale"))
    done = materialize(decode.hash_files(todo, params, open_media), "hashed")
    try:
        rows = cache.rows_of(done, params)
        if base is None:
            cache.write_cache(rows, at, Version(last_number(spark, at)))
        else:
            cache.write_changes(spark, at, base, rows, stored.join(files, "path", "left_anti"))
            vacuum(spark, at)
    except Exception:  # the next run hashes again
        log.exception("the cache %s was not written", at)
    hits = classified.filter("class = 'hit'").select("path", "hashes")
    skips = classified.filter("class = 'skipped'").select("path", F.lit("cached").alias("reason"))
    return hits.unionByName(done.filter("status = 'ok'").select("path", "hashes")), skips.unionByName(done.filter("status in ('skipped', 'failed')").select("path", "reason"))


@dataclass
class Found:
    """Groups ``(group_id, n_members, n_edges, avg_similarity)`` and their members ``(group_id, path)``, and what else a run gives."""

    groups: DataFrame
    members: DataFrame
    report: DataFrame
    watched: DataFrame | None
    unwatched: DataFrame
    skipped: DataFrame
    moved: dict[str, tuple[int, int]]
    added: dict[str, int]


def _journal(folder: str, name: str) -> str:
    return os.path.join(folder, f".moves_to_{name}")


def _move(files: DataFrame, folder: str, name: str, rename: bool) -> tuple[int, int, set[str]]:
    to = os.path.join(folder, name)
    there = files.sparkSession.createDataFrame([(x,) for x in (os.listdir(to) if os.path.isdir(to) else [])], "name string")
    return apply_moves(move_plan(files, to, there, rename), _journal(folder, name))


def find_similar(
    spark: SparkSession, folder: str, params: Params, recursive: bool = False, watched_db: str | None = None, adopt_params: bool = False,
    move_watched: bool = False, move_duplicates: bool = False, move_skipped: bool = False, open_media=decode.VideoMedia, strategy: str = "auto", cache_name: str | None = None,
) -> Found:
    """Watched files are set apart (moved or not), the rest is grouped, and what stays unique joins the watched set."""
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    folder = os.path.abspath(folder)
    seen = None
    if watched_db:
        watched_db = os.path.abspath(watched_db)
        seen, meta = watched.read_watched(spark, watched_db)
        if meta and (meta["num_frames"], meta["hash_size"]) != (params.num_frames, params.hash_size):
            if not adopt_params:
                raise ValueError("the watched set was made with other parameters")
            params = Params(meta["num_frames"], meta["hash_size"], params.threshold, params.skip_duration)
    # Moves that an earlier run began are finished first; they count among this run's.
    begun = {kind: resume_moves(_journal(folder, name))[:2] for kind, name in zip(("duplicates", "watched", "skipped"), RESERVED_FOLDERS, strict=True)}
    moved: dict[str, tuple[int, int]] = {}

    def move(kind: str, files: DataFrame, name: str, rename: bool) -> None:
        n, failed, _ = _move(files, folder, name, rename)
        moved[kind] = (begun[kind][0] + n, begun[kind][1] + failed)

    signatures, skipped = hash_folder(spark, folder, params, recursive, cache_name, open_media)
    signatures, skipped = materialize(signatures, "signatures"), materialize(skipped, "skipped")
    split, rest = None, signatures
    if seen is not None:
        split = materialize(split_watched(signatures, watched.pool(seen, params.words), params), "split")
        rest = signatures.join(split.filter("not is_watched"), "path", "left_semi")
        if move_watched:
            move("watched", split.filter("is_watched").select("path", F.lit(0).alias("seq")), RESERVED_FOLDERS[1], True)
    classes, pairs = (materialize(x, "similar") for x in similar_classes(rest, params, strategy))
    members = materialize(group_members(classes, pairs), "members")
    groups = materialize(group_scores(classes, pairs, members), "groups")
    total = totals(classes, groups).first()
    log.info("%d items, %d pairs of them compared; %d similar pairs of distinct signatures, %d groups, %d files to move", total["n_items"], total["n_pairs"], pairs.count(), total["n_groups"], total["n_to_move"])
    report = materialize(group_report(groups, list_media(spark, folder, recursive), members), "report")
    gone = rest.limit(0).select("path")
    if move_duplicates:
        move("duplicates", report.select("path", F.col("group_no").alias("seq")), RESERVED_FOLDERS[0], True)
        gone = report.select("path")
    if move_skipped:
        move("skipped", skipped.select("path", F.lit(0).alias("seq")), RESERVED_FOLDERS[2], False)
    unique = final_unique(rest, gone)
    added = watched.write_watched(spark, watched_db, watched.entries(unique, params.words), params) if watched_db else {}
    return Found(groups, members, report, split, unique, skipped, moved, added)


def final_unique(candidates: DataFrame, moved: DataFrame) -> DataFrame:
    """Candidates that were not moved away."""
    return candidates.join(moved.select("path").distinct(), "path", "left_anti")


def create_watched(spark: SparkSession, folder: str, params: Params, db: str | None = None, recursive: bool = False, open_media=decode.VideoMedia, cache_name: str | None = None) -> dict[str, int]:
    """Every file that can be hashed joins the watched set, in one write."""
    from twinframe.params import WATCHED_NAME

    signatures, _ = hash_folder(spark, folder, params, recursive, cache_name, open_media)
    return watched.write_watched(spark, os.path.abspath(db or os.path.join(folder, WATCHED_NAME)), watched.entries(signatures, params.words), params)


def inspect(spark: SparkSession, db: str) -> DataFrame:
    return watched.summary(*watched.read_watched(spark, os.path.abspath(db)))
