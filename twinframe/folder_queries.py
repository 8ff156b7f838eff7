"""Queries of the lister, the decoder and whole runs over a folder of files, and their SQL.

The files are made from the documents table: a document's text is cut into frames of 64 characters,
8 by 8, ten a second. Some files are damaged, by their number: the last frame is cut off, one in the middle
cannot be decoded, or no frames are in the file. The folder is a new one in the shared folder, which has to
be a mounted one, as media files are opened by path.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe import queries as media
from twinframe.functions.signatures import to_hex
from twinframe.params import RESERVED_FOLDERS, Params
from twinframe.plans import runs
from twinframe.sources import watched
from twinframe.sources.cache import read_cache
from twinframe.sources.decode import hash_files
from twinframe.sources.frames import UNREADABLE, FrameFile, write_frames
from twinframe.sources.listing import cache_path, list_media
from twinframe.sources.shared import materialize, scratch

PARAMS = Params(skip_duration=3)
FPS, NO_FRAMES, EPOCH = 10.0, b"no frames", 1_600_000_000.5
#: What is wrong with a file, by the remainder of its number; the last kind is gone when it is decoded.
KINDS = 13
CUT, BROKEN, EMPTY, GONE = range(4)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, rel, kind, text)`` of the files to write."""
    d = media._table(spark, sf_dir, "documents", "doc_id", "text", "source").filter("text is not null and source is not null")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    rel = F.concat("source", F.lit("/"), pick(media.FOLDERS), F.col("doc_id").cast("string"), F.lit("."), pick(media.ENDINGS))
    return d.select("doc_id", rel.alias("rel"), (F.col("doc_id") % KINDS).alias("kind"), "text")


def _write(files: DataFrame, folder: str, later: float = 0.0) -> None:
    """Write the files below the folder, in tasks; ``later`` is added to their times."""

    def write(rows):
        import numpy as np

        from twinframe.sources.decode import sample_indices

        for r in rows:
            path, mtime = os.path.join(folder, r["rel"]), EPOCH + r["doc_id"] + later
            points = np.frombuffer(r["text"].encode("utf-32-le"), dtype="<u4")
            n = len(points) // 64
            frames = points[: 64 * n].reshape(n, 8, 8)
            if r["kind"] == EMPTY:
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(NO_FRAMES)
                os.utime(path, (mtime, mtime))
                continue
            if r["kind"] == BROKEN and n:
                frames = frames.copy()
                frames[sample_indices(n, PARAMS.num_frames)[PARAMS.num_frames // 2]] = UNREADABLE
            write_frames(path, frames, FPS, 4 if r["kind"] == CUT and n else 0, mtime)

    files.foreachPartition(write)


def _folder(spark: SparkSession, sf_dir: str) -> str:
    url = urlparse(scratch(spark, "media-folder"))
    if url.scheme not in ("", "file"):
        raise RuntimeError("media files need a mounted folder")
    _write(_files(spark, sf_dir), url.path)
    return url.path


def _rel(col, folder: str):
    return F.substr(col, F.lit(len(folder) + 2))


def _hex(col):
    return F.array_join(F.transform(col, lambda h: to_hex(h)), ",")


def folder_listing(spark, sf_dir):
    folder = _folder(spark, sf_dir)
    return list_media(spark, folder, True).select(_rel("path", folder).alias("path"), "mtime", "size_bytes")


def folder_listing_flat(spark, sf_dir):
    """One folder without those below it."""
    folder = _folder(spark, sf_dir)
    return list_media(spark, f"{folder}/src0").select(_rel("path", folder).alias("path"), "size_bytes")


def folder_listing_pushed(spark, sf_dir):
    """Conditions that the lister tests itself: folders that cannot hold such paths are not opened."""
    folder = _folder(spark, sf_dir)
    found = list_media(spark, folder, True, folders=4)
    found = found.filter(F.col("path").startswith(f"{folder}/src1") & (F.col("size_bytes") >= 2000) & (F.col("mtime") < EPOCH + 1e9))
    return found.select(_rel("path", folder).alias("path"), "size_bytes")


def folder_hashes(spark, sf_dir):
    """Every listed file's result, those included that are gone when they are decoded."""
    folder = _folder(spark, sf_dir)
    files = materialize(list_media(spark, folder, True), "files")
    _remove(_files(spark, sf_dir).filter(F.col("kind") == GONE), folder)
    out = hash_files(files, PARAMS, FrameFile)
    return out.select(_rel("path", folder).alias("path"), "status", "reason", _hex("hashes").alias("hashes"))


def _remove(files: DataFrame, folder: str) -> None:
    def remove(rows):
        for r in rows:
            os.remove(os.path.join(folder, r["rel"]))

    files.select("rel").foreachPartition(remove)


def folder_rescan(spark, sf_dir):
    """Two runs: between them some files go, and those without frames get some. What the second one gives, and what the cache holds then."""
    folder = _folder(spark, sf_dir)
    runs.hash_folder(spark, folder, PARAMS, True, open_media=FrameFile)
    files = _files(spark, sf_dir)
    _remove(files.filter(F.col("kind") == GONE), folder)
    _write(files.filter(F.col("kind") == EMPTY).withColumn("kind", F.lit(-1)), folder, 1.0)
    signatures, skipped = runs.hash_folder(spark, folder, PARAMS, True, open_media=FrameFile)
    given = signatures.select("path", F.lit("ok").alias("given"), "hashes").unionByName(skipped.select("path", F.col("reason").alias("given")), allowMissingColumns=True)
    kept = read_cache(spark, cache_path(folder)).select("path", "status", "mtime")
    return given.join(kept, "path", "full").select(_rel("path", folder).alias("path"), "given", _hex("hashes").alias("hashes"), "status", "mtime")


def folder_report(spark, sf_dir):
    folder = _folder(spark, sf_dir)
    found = runs.find_similar(spark, folder, PARAMS, True, open_media=FrameFile)
    rows = found.report.drop("avg_similarity").join(found.members.select("path", "group_id"), "path").join(found.groups, "group_id")
    return rows.select(_rel("group_id", folder).alias("group_id"), _rel("path", folder).alias("path"), "n_members", "n_edges", F.round("avg_similarity", 6).alias("avg_similarity"), "size_text")


def folder_moves(spark, sf_dir):
    """Where the media files are after groups and skipped files were moved away."""
    folder = _folder(spark, sf_dir)
    runs.find_similar(spark, folder, PARAMS, True, move_duplicates=True, move_skipped=True, open_media=FrameFile)
    out = list_media(spark, folder, True)
    for name in RESERVED_FOLDERS:
        out = out.unionByName(list_media(spark, f"{folder}/{name}"))
    return out.select(_rel("path", folder).alias("path"))


def folder_watched(spark, sf_dir):
    """A watched set made from one folder, matched against another that is listed without the folders below it."""
    folder = _folder(spark, sf_dir)
    db = f"{folder}/seen"
    runs.create_watched(spark, f"{folder}/src0", PARAMS, db, True, open_media=FrameFile)
    found = runs.find_similar(spark, f"{folder}/src5", PARAMS, watched_db=db, open_media=FrameFile)
    split = found.watched.select(_rel("path", folder).alias("path"), F.round("similarity", 6).alias("similarity"), "is_watched")
    held = watched.summary(*watched.read_watched(spark, db)).first()
    return split.select("*", F.lit(held["n_videos"]).cast("bigint").alias("n_videos"), *(F.lit(held[c]).alias(c) for c in ("num_frames", "hash_size")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (folder_listing, folder_listing_flat, folder_listing_pushed, folder_hashes, folder_rescan, folder_report, folder_moves, folder_watched)
}

_T = """a AS (SELECT doc_id, text, CAST(length(text) // 64 AS INTEGER) AS total_frames, CAST(doc_id % 13 AS INTEGER) AS kind, source, source || '/' || ['', 'sub/', 'watched_videos/', 'sub/duplicate_videos/deep/', 'my_watched_videos/'][doc_id % 5 + 1]
  || CAST(doc_id AS VARCHAR) || '.' || ['mp4', 'MKV', 'txt', 'tar.mov', 'Wmv', 'mp4.part', 'flv'][doc_id % 7 + 1] AS path FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
m AS (SELECT *, 1600000000.5::DOUBLE + doc_id AS mtime, CAST(CASE WHEN kind = 2 THEN 9 ELSE 20 + 256 * total_frames - CASE WHEN kind = 0 AND total_frames > 0 THEN 4 ELSE 0 END END AS BIGINT) AS size_bytes,
  regexp_matches(lower(path), '\\.(mp4|avi|mkv|mov|wmv|flv)$') AND NOT regexp_matches(path, '(^|/)(duplicate_videos|watched_videos|skipped_videos)/') AS listed,
  regexp_matches(lower(path), '\\.(mp4|avi|mkv|mov|wmv|flv)$') AS is_media FROM a),
t AS (SELECT *, CASE WHEN kind = 2 THEN 'failed' WHEN total_frames < 30 THEN 'skipped' WHEN kind IN (0, 1) THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN kind = 2 THEN 'not opened: OSError' WHEN total_frames < 30 THEN 'short' WHEN kind = 0 THEN 'last frame unreadable' WHEN kind = 1 THEN 'frame unreadable' ELSE '' END AS reason FROM m WHERE listed)"""


def _hashed(which: str) -> str:
    """The tree, and the hashes ``hs(path, f, h)`` of the files of a condition, as the documents' own are made."""
    return f"{_T}, ix AS (SELECT doc_id, path, text, total_frames, unnest(range(20)) AS f FROM t WHERE {which}), " + media._DF[media._DF.index("fr AS") :]


_HEX = "SELECT path, string_agg(lpad(lower(to_hex(h)), 16, '0'), ',' ORDER BY f) AS hashes FROM hs GROUP BY path"
_FOUND = _hashed("status = 'ok'") + ", " + media._GROUPS[media._GROUPS.index("sg AS") :]

ORACLE_SQL: dict[str, str] = {
    "folder_listing": f"WITH {_T} SELECT path, mtime, size_bytes FROM t",
    "folder_listing_flat": f"WITH {_T} SELECT path, size_bytes FROM t WHERE source = 'src0' AND doc_id % 5 = 0",
    "folder_listing_pushed": f"WITH {_T} SELECT path, size_bytes FROM t WHERE starts_with(path, 'src1') AND size_bytes >= 2000",
    "folder_hashes": f"""WITH {_hashed("status = 'ok' AND kind <> 3")}, x AS ({_HEX})
      SELECT path, CASE WHEN kind = 3 THEN 'vanished' ELSE status END AS status, CASE WHEN kind = 3 THEN 'not found' ELSE reason END AS reason, hashes FROM t LEFT JOIN x USING (path)""",
    "folder_rescan": f"""WITH {_hashed("kind <> 3 AND total_frames >= 30 AND kind NOT IN (0, 1)")}, x AS ({_HEX})
      SELECT path, CASE WHEN hashes IS NOT NULL THEN 'ok' WHEN kind = 2 THEN 'short' ELSE 'cached' END AS given, hashes, CASE WHEN hashes IS NULL THEN 'SKIPPED' ELSE 'OK' END AS status, mtime + CASE WHEN kind = 2 THEN 1 ELSE 0 END AS mtime
      FROM t LEFT JOIN x USING (path) WHERE kind <> 3""",
    "folder_report": f"""WITH RECURSIVE {_FOUND} SELECT group_id, co.x AS path, n_members, n_edges, avg_similarity, printf('%.2f KB', size_bytes / 1024.0::DOUBLE) AS size_text
      FROM gr JOIN sc USING (group_id) JOIN co ON co.g = group_id JOIN t ON t.path = co.x""",
    "folder_moves": f"""WITH RECURSIVE {_FOUND} SELECT CASE WHEN x IS NOT NULL THEN 'duplicate_videos/' WHEN status <> 'ok' THEN 'skipped_videos/' END || regexp_replace(path, '^.*/', '') AS path FROM t LEFT JOIN co ON x = path WHERE x IS NOT NULL OR status <> 'ok'
      UNION ALL SELECT path FROM t LEFT JOIN co ON x = path WHERE x IS NULL AND status = 'ok'""",
    "folder_watched": f"""WITH {_hashed("status = 'ok' AND (source = 'src0' OR source = 'src5' AND doc_id % 5 = 0)")}, w AS (SELECT DISTINCT h FROM hs JOIN t USING (path) WHERE source = 'src0'),
      q AS (SELECT DISTINCT h FROM hs JOIN t USING (path) WHERE source = 'src5'), nn AS (SELECT q.h, min(bit_count(xor(q.h, w.h))) AS dist FROM q, w GROUP BY q.h),
      s AS (SELECT path, greatest(0.0, (64.0::DOUBLE - CAST(sum(dist) AS DOUBLE) / 20) / 64) * 100 AS similarity FROM hs JOIN t USING (path) JOIN nn USING (h) WHERE source = 'src5' GROUP BY path)
      SELECT path, round(similarity, 6) AS similarity, similarity >= 90 AS is_watched, n_videos, 20 AS num_frames, 8 AS hash_size
      FROM s, (SELECT count(*) FILTER (source = 'src0') + count(*) FILTER (source = 'src5' AND doc_id % 5 = 0 AND NOT coalesce(is_w, false)) AS n_videos FROM t LEFT JOIN (SELECT path, similarity >= 90 AS is_w FROM s) USING (path) WHERE status = 'ok')""",
}
