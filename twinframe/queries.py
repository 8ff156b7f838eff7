"""Queries of the media operators over the driver's tables, and their SQL.

There are no media files here, so two tables stand in for them. A document is an item whose frames
are blocks of 64 characters, with the characters' code points for pixels. An embedding is an item of
four frames of 16 numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions import paths
from twinframe.functions.signatures import aligned_similarity, average_hash, frame_indices, to_hex
from twinframe.operators import metric_index
from twinframe.operators.groups import group_members, group_scores, totals
from twinframe.operators.groups import group_report as report_of
from twinframe.operators.groups import similar_groups as groups_of
from twinframe.operators.moves import move_plan as plan_of
from twinframe.operators.similarity import similar_classes, similar_pairs
from twinframe.operators.watched import nearest_distance, split_watched
from twinframe.params import Params
from twinframe.plans.runs import final_unique as unique_of
from twinframe.sources import cache, watched
from twinframe.sources.shared import materialize, scratch
from twinframe.sources.versions import vacuum

DOC = Params()
EMB = Params(num_frames=4, hash_size=4, threshold=70.0)
EMB_WATCHED = Params(num_frames=4, hash_size=4, threshold=85.0)


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, number of frames, text, size."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars").filter("text is not null")
    path = F.concat(F.lit("/media/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".mp4"))
    return docs.select("doc_id", path.alias("path"), F.floor(F.length("text") / 64).cast("int").alias("total_frames"), "text", F.col("n_chars").alias("size_bytes"))


def _text_hashes(text: bytes, total: int) -> np.ndarray:
    """The average hashes of a text's frames, as ``frame_indices`` and ``average_hash`` give them."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")[: total * 64]
    points = np.pad(points, (0, total * 64 - len(points))).reshape(total, 64)
    at = np.floor(np.arange(DOC.num_frames) * ((total - 1) / (DOC.num_frames - 1))).astype(np.int64)
    at[-1] = total - 1
    frames = points[at]
    return np.packbits(frames > frames.sum(axis=1, keepdims=True) / 64, axis=1).view(">i8").astype(np.int64).ravel()


def _doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, doc_id, hashes)`` of the documents that are long enough, a row each; texts are hashed in Arrow batches like other frames."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = _docs(spark, sf_dir).filter(F.col("total_frames") >= DOC.num_frames).select("path", "doc_id", F.col("text").cast("binary").alias("text"), "total_frames")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [_text_hashes(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("total_frames").to_pylist(), strict=True)]
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * DOC.num_frames)
            hashes = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("doc_id"), hashes], ["path", "doc_id", "hashes"])

    return docs.repartition(parts).mapInArrow(run, f"path string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, hashes array<bigint>")


def _doc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, doc_id, frame_idx, hash)`` of the documents that are long enough."""
    return _doc_hashes(spark, sf_dir).select("path", "doc_id", F.posexplode("hashes").alias("frame_idx", "hash"))


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, hashes)``; a path that several documents have gets the frames of all."""
    return _doc_hashes(spark, sf_dir).groupBy("path").agg(F.flatten(F.collect_list("hashes")).alias("hashes"))


def _emb_path(col: str = "vec_id"):
    return F.concat(F.lit("/media/"), F.lpad(F.col(col).cast("string"), 12, "0"), F.lit(".mp4"))


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, vec_id, label, hashes)`` of the embeddings."""
    e = _table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull() & (F.size("embedding") == 64))
    v = F.transform("embedding", lambda x: x.cast("double"))
    hashes = F.array(*[average_hash(F.slice(v, 16 * i + 1, 16), 16)[0] for i in range(4)])
    return e.select(_emb_path().alias("path"), "vec_id", "label", hashes.alias("hashes"))


def frame_sample_indices(spark, sf_dir):
    d = _docs(spark, sf_dir).filter(F.col("total_frames") > 0)
    return d.select("doc_id", F.posexplode(frame_indices(F.col("total_frames"), DOC.num_frames)).alias("frame_idx", "frame_no"))


def frame_hashes_doc(spark, sf_dir):
    return _doc_frames(spark, sf_dir).select("doc_id", "frame_idx", to_hex(F.col("hash")).alias("hash"))


def frame_hashes_emb(spark, sf_dir):
    e = _emb(spark, sf_dir).select("vec_id", F.posexplode("hashes").alias("frame_idx", "h"))
    return e.select("vec_id", "frame_idx", to_hex(F.col("h"), 16).alias("hash"))


def skipped_inputs(spark, sf_dir):
    d = _docs(spark, sf_dir).filter(F.col("total_frames") < DOC.num_frames)
    return d.select("doc_id", "path", "total_frames", F.lit("short").alias("reason"))


def pair_similarity(spark, sf_dir):
    e = _emb(spark, sf_dir).select("vec_id", "hashes")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hashes").alias("other"))
    return e.join(b, "vec_id").select("vec_id", aligned_similarity(F.col("hashes"), F.col("other"), EMB.bits).alias("similarity"))


def similar_pairs_brute(spark, sf_dir):
    return similar_pairs(materialize(_signatures(spark, sf_dir), "signatures"), DOC, "blocks")


def similar_pairs_mih(spark, sf_dir):
    return similar_pairs(materialize(_signatures(spark, sf_dir), "signatures"), DOC, "bands")


def similar_pairs_emb(spark, sf_dir):
    return similar_pairs(materialize(_emb(spark, sf_dir).select("path", "hashes"), "signatures"), EMB)


def _classes(spark, sf_dir):
    """Classes of equal signatures, and the similar pairs of their representatives, both written."""
    classes, pairs = similar_classes(materialize(_signatures(spark, sf_dir), "signatures"), DOC)
    return materialize(classes, "classes"), materialize(pairs, "pairs")


def similar_groups(spark, sf_dir):
    classes, pairs = _classes(spark, sf_dir)
    return groups_of(pairs, classes).select("group_id", F.array_join("members", ",").alias("members"), "n_members", "n_edges", F.round("avg_similarity", 6).alias("avg_similarity"))


def group_report(spark, sf_dir):
    classes, pairs = _classes(spark, sf_dir)
    members = materialize(group_members(classes, pairs), "members")
    scores = group_scores(classes, pairs, members).withColumn("avg_similarity", F.round("avg_similarity", 6))
    rows = report_of(scores, _docs(spark, sf_dir).select("path", "size_bytes"), members)
    return rows.withColumn("group_no", F.col("group_no").cast("int"))


def group_totals(spark, sf_dir):
    classes, pairs = _classes(spark, sf_dir)
    return totals(classes, group_scores(classes, pairs, materialize(group_members(classes, pairs), "members")))


def _pool(e: DataFrame) -> DataFrame:
    return e.filter("label = 0").select(F.explode("hashes").alias("hash"))


def watched_nn_distance(spark, sf_dir):
    e = _emb(spark, sf_dir)
    near = nearest_distance(e.filter("label != 0").select(F.explode("hashes").alias("hash")), _pool(e), 16)
    return near.select(to_hex(F.col("hash"), 16).alias("hash"), F.col("distance").cast("int").alias("distance"))


def metric_index_range(spark, sf_dir):
    """An index made of one label's frames, to which another's are added, asked for what is within 2 bits of the others'."""
    e, at = _emb(spark, sf_dir), scratch(spark, "metric-index")
    frames = lambda which: e.filter(which).select(F.explode("hashes").alias("hash"))
    metric_index.create(spark, at, frames("label = 0"))
    metric_index.add(spark, at, frames("label = 1"))
    near = metric_index.ask(spark, at, frames("label > 1"), 2)
    return near.select(to_hex(F.col("hash"), 16).alias("hash"), to_hex(F.col("seen"), 16).alias("seen"), "distance")


def watched_split(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return split_watched(e.filter("label != 0"), _pool(e), EMB_WATCHED)


def unwatched_set(spark, sf_dir):
    return watched_split(spark, sf_dir).filter("not is_watched").select("path")


def _listing(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "path", (F.col("doc_id") % 97).cast("double").alias("mtime"))


def _old_cache(spark, sf_dir):
    """An older cache: two thirds of the files, some with another mtime or other parameters, some of files that are gone."""
    d, m = _docs(spark, sf_dir).filter("doc_id % 3 != 0"), F.col("doc_id")
    gone = F.when(m % 11 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    ok = F.col("total_frames") >= DOC.num_frames
    return d.select(
        gone.alias("path"), F.when(ok, "OK").otherwise("SKIPPED").alias("status"), F.when(ok, F.array(F.col("doc_id"))).alias("hashes"),
        F.when(m % 5 == 0, -1.0).otherwise((m % 97).cast("double")).alias("mtime"), F.when(m % 7 == 0, 10).otherwise(20).alias("num_frames"), F.lit(8).alias("hash_size"),
    )


def _classified(spark, sf_dir):
    return cache.classify(_listing(spark, sf_dir).select("path", "mtime"), _old_cache(spark, sf_dir), DOC)


def cache_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("path", F.col("class").alias("state"))


def cache_stats(spark, sf_dir):
    return cache.stats(_classified(spark, sf_dir))


def cache_prune(spark, sf_dir):
    return cache.prune(_old_cache(spark, sf_dir), _listing(spark, sf_dir)).select("path", "status", "mtime", "num_frames")


def cache_upsert(spark, sf_dir):
    todo = _classified(spark, sf_dir).filter(F.col("class").isin("miss", "stale"))
    new = todo.select("path", "mtime", F.lit("ok").alias("status"), F.array(F.lit(1).cast("bigint")).alias("hashes"))
    kept = cache.prune(_old_cache(spark, sf_dir), _listing(spark, sf_dir))
    return cache.upsert(kept, cache.rows_of(new, DOC)).select("path", "status", "mtime", "num_frames", "hash_size", F.size("hashes").alias("n_hashes"))


def cache_store(spark, sf_dir):
    """The same through the stored cache: written whole, then the changes alone, and read back."""
    at = scratch(spark, "cache")
    base = cache.write_cache(_old_cache(spark, sf_dir), at)
    classified = _classified(spark, sf_dir)
    new = classified.filter(F.col("class").isin("miss", "stale")).select("path", "mtime", F.lit("ok").alias("status"), F.array(F.lit(1).cast("bigint")).alias("hashes"))
    cache.write_changes(spark, at, base, cache.rows_of(new, DOC), cache.read_cache(spark, at, base).join(classified, "path", "left_anti"))
    vacuum(spark, at)
    return cache.read_cache(spark, at).select("path", "status", "mtime", "num_frames", "hash_size", F.size("hashes").alias("n_hashes"))


#: Names that a listing of the documents' folder would hold.
ENDINGS = ("mp4", "MKV", "txt", "tar.mov", "Wmv", "mp4.part", "flv")
FOLDERS = ("", "sub/", "watched_videos/", "sub/duplicate_videos/deep/", "my_watched_videos/")


def file_listing(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % n + 1).cast("int"))
    rel = F.concat(pick(FOLDERS, len(FOLDERS)), F.col("doc_id").cast("string"), F.lit("."), pick(ENDINGS, len(ENDINGS)))
    d = d.select("doc_id", rel.alias("path"))
    return d.filter(paths.is_media(F.col("path")) & ~paths.in_reserved_folder(F.col("path"))).select("doc_id", "path", paths.basename(F.col("path")).alias("name"), paths.stem(F.col("path")).alias("stem"))


def _watched_entries(spark, sf_dir):
    """Entries of an older watched set, and those that are written to it."""
    e = _emb(spark, sf_dir)
    new = e.filter("vec_id % 2 = 0").withColumn("hashes", F.when(F.col("vec_id") % 5 == 0, F.slice("hashes", 1, 2)).otherwise(F.col("hashes")))
    return watched.entries(e.filter("vec_id % 3 != 0")), watched.entries(new)


def watched_upsert_status(spark, sf_dir):
    return watched.upsert_status(*_watched_entries(spark, sf_dir)).select("video_id", "status", F.size("hashes").alias("n_hashes"))


def watched_store(spark, sf_dir):
    """The stored set after both writes, read back."""
    at = scratch(spark, "watched")
    for entries in _watched_entries(spark, sf_dir):
        watched.write_watched(spark, at, entries, EMB)
    return watched.read_watched(spark, at)[0].select("video_id", F.array_join(F.transform("hashes", lambda h: F.right(h, F.lit(4))), ",").alias("hashes"))


def final_unique(spark, sf_dir):
    classes, pairs = _classes(spark, sf_dir)
    return unique_of(classes, group_members(classes, pairs)).select("path")


def inspect_db(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return watched.summary(watched.entries(e.filter("label = 0")), {"num_frames": EMB.num_frames, "hash_size": EMB.hash_size})


def move_plan(spark, sf_dir):
    d = _table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    files = d.select(F.concat(F.lit("/media/"), "source", F.lit("/"), "lang", F.lit("_"), (F.col("doc_id") % 50).cast("string"), F.lit("x.mp4")).alias("path"), F.col("doc_id").alias("seq"))
    return plan_of(files, "/media/duplicate_videos")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        frame_sample_indices, frame_hashes_doc, frame_hashes_emb, skipped_inputs, pair_similarity, similar_pairs_brute, similar_pairs_mih, similar_pairs_emb, similar_groups, group_report, group_totals, watched_nn_distance, metric_index_range,
        watched_split, unwatched_set, cache_classify, cache_stats, cache_prune, cache_upsert, cache_store, file_listing, watched_upsert_status, watched_store, final_unique, inspect_db, move_plan,
    )
}

_D = """d AS (SELECT doc_id, '/media/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.mp4' AS path, CAST(length(text) // 64 AS INTEGER) AS total_frames, text, n_chars
  FROM documents WHERE text IS NOT NULL)"""
_AT = "CAST(CASE WHEN f = 19 THEN total_frames - 1 ELSE floor(f * (CAST(total_frames - 1 AS DOUBLE) / 19)) END AS INTEGER)"
_DF = f"""{_D}, ix AS (SELECT doc_id, path, text, total_frames, unnest(range(20)) AS f FROM d WHERE total_frames >= 20),
fr AS (SELECT doc_id, path, f, list_transform(string_split(substring(text, {_AT} * 64 + 1, 64), ''), lambda c: CAST(unicode(c) AS DOUBLE)) AS c FROM ix),
mn AS (SELECT doc_id, path, f, c, list_sum(c) / len(c) AS m FROM fr),
hs AS (SELECT doc_id, path, f, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN c[i + 1] > m THEN (CAST(1 AS UBIGINT) << CAST(63 - i AS UBIGINT)) ELSE CAST(0 AS UBIGINT) END)) AS UBIGINT) AS h FROM mn)"""
_PAIRS = f"""{_DF}, sg AS (SELECT path, list(h ORDER BY f) AS hs FROM hs GROUP BY path),
pr AS (SELECT a.path AS a, b.path AS b, greatest(0.0, (64.0::DOUBLE - list_sum(list_transform(range(20), lambda i: CAST(bit_count(xor(a.hs[i + 1], b.hs[i + 1])) AS BIGINT)))::DOUBLE / 20) / 64) * 100 AS similarity
  FROM sg a JOIN sg b ON a.path < b.path),
ed AS (SELECT * FROM pr WHERE similarity >= 90)"""
_GROUPS = f"""{_PAIRS}, un AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
re AS (SELECT a AS x, a AS y FROM un UNION SELECT re.x, un.b FROM re JOIN un ON re.y = un.a),
co AS (SELECT x, min(y) AS g FROM re GROUP BY x),
gr AS (SELECT g AS group_id, string_agg(x, ',' ORDER BY x) AS members, count(*) AS n_members FROM co GROUP BY g),
sc AS (SELECT g AS group_id, count(*) AS n_edges, round(avg(similarity), 6) AS avg_similarity FROM ed JOIN co ON ed.a = co.x GROUP BY g)"""
_E = """e AS (SELECT vec_id, label, '/media/' || lpad(CAST(vec_id AS VARCHAR), 12, '0') || '.mp4' AS path, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64),
ef AS (SELECT vec_id, label, path, f, list_slice(v, 16 * f + 1, 16 * f + 16) AS c FROM (SELECT *, unnest(range(4)) AS f FROM e)),
eh AS (SELECT vec_id, label, path, f, CAST(list_sum(list_transform(range(16), lambda i: CASE WHEN c[i + 1] > m THEN (CAST(1 AS BIGINT) << (15 - i)) ELSE 0 END)) AS BIGINT) AS h
  FROM (SELECT *, list_sum(c) / 16 AS m FROM ef))"""
_W = f"""{_E}, nn AS (SELECT x.h, min(bit_count(xor(x.h, w.h))) AS dist FROM (SELECT DISTINCT h FROM eh WHERE label <> 0) x, (SELECT DISTINCT h FROM eh WHERE label = 0) w GROUP BY x.h),
sp AS (SELECT path, greatest(0.0, (16.0::DOUBLE - CAST(sum(dist) AS DOUBLE) / 4) / 16) * 100 AS similarity FROM eh JOIN nn USING (h) WHERE label <> 0 GROUP BY path)"""
_U = f"""{_E}, o AS (SELECT path, list_sort(list(DISTINCT h)) AS hs FROM eh WHERE vec_id % 3 <> 0 GROUP BY path),
n AS (SELECT path, list_sort(list(DISTINCT h)) AS hs FROM eh WHERE vec_id % 2 = 0 AND (vec_id % 5 <> 0 OR f < 2) GROUP BY path)"""
_C = f"""{_D}, ls AS (SELECT path, CAST(doc_id % 97 AS DOUBLE) AS mtime FROM d),
oc AS (SELECT CASE WHEN doc_id % 11 = 0 THEN path || '.gone' ELSE path END AS path, CASE WHEN total_frames >= 20 THEN 'OK' ELSE 'SKIPPED' END AS status, total_frames >= 20 AS ok,
  CASE WHEN doc_id % 5 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(doc_id % 97 AS DOUBLE) END AS mtime, CASE WHEN doc_id % 7 = 0 THEN 10 ELSE 20 END AS num_frames FROM d WHERE doc_id % 3 <> 0),
cl AS (SELECT ls.path, ls.mtime, CASE WHEN oc.path IS NULL THEN 'miss' WHEN oc.mtime <> ls.mtime OR oc.num_frames <> 20 THEN 'stale' WHEN oc.ok THEN 'hit' ELSE 'skipped' END AS state FROM ls LEFT JOIN oc USING (path))"""

ORACLE_SQL: dict[str, str] = {
    "frame_sample_indices": f"WITH {_D} SELECT doc_id, CAST(f AS INTEGER) AS frame_idx, {_AT} AS frame_no FROM (SELECT *, unnest(range(20)) AS f FROM d WHERE total_frames > 0)",
    "frame_hashes_doc": f"WITH {_DF} SELECT doc_id, CAST(f AS INTEGER) AS frame_idx, lpad(lower(to_hex(h)), 16, '0') AS hash FROM hs",
    "frame_hashes_emb": f"WITH {_E} SELECT vec_id, CAST(f AS INTEGER) AS frame_idx, lpad(lower(to_hex(h)), 4, '0') AS hash FROM eh",
    "skipped_inputs": f"WITH {_D} SELECT doc_id, path, total_frames, 'short' AS reason FROM d WHERE total_frames < 20",
    "pair_similarity": f"""WITH {_E} SELECT a.vec_id, greatest(0.0, (16.0::DOUBLE - CAST(sum(bit_count(xor(a.h, b.h))) AS DOUBLE) / 4) / 16) * 100 AS similarity
      FROM eh a JOIN eh b ON b.vec_id = a.vec_id + 1 AND a.f = b.f GROUP BY a.vec_id""",
    "similar_pairs_brute": f"WITH {_PAIRS} SELECT a, b, similarity FROM ed",
    "similar_pairs_mih": f"WITH {_PAIRS} SELECT a, b, similarity FROM ed",
    "similar_pairs_emb": f"""WITH {_E}, pr AS (SELECT a.path AS a, b.path AS b, greatest(0.0, (16.0::DOUBLE - CAST(sum(bit_count(xor(a.h, b.h))) AS DOUBLE) / 4) / 16) * 100 AS similarity
      FROM eh a JOIN eh b ON a.path < b.path AND a.f = b.f GROUP BY a.path, b.path) SELECT * FROM pr WHERE similarity >= 70""",
    "similar_groups": f"WITH RECURSIVE {_GROUPS} SELECT group_id, members, n_members, n_edges, avg_similarity FROM gr JOIN sc USING (group_id)",
    "group_report": f"""WITH RECURSIVE {_GROUPS}, nr AS (SELECT group_id, avg_similarity, CAST(row_number() OVER (ORDER BY avg_similarity DESC, group_id) AS INTEGER) AS group_no FROM sc)
      SELECT group_no, co.x AS path, avg_similarity, CASE WHEN n_chars = 0 THEN '0 B' WHEN n_chars < 1024 THEN printf('%.2f B', CAST(n_chars AS DOUBLE)) WHEN n_chars < 1048576 THEN printf('%.2f KB', n_chars / 1024.0::DOUBLE) ELSE printf('%.2f MB', n_chars / 1048576.0::DOUBLE) END AS size_text
      FROM nr JOIN co ON co.g = nr.group_id JOIN d ON d.path = co.x""",
    "group_totals": f"""WITH RECURSIVE {_GROUPS}, n AS (SELECT count(*) AS n FROM sg)
      SELECT n AS n_items, CAST(n * (n - 1) // 2 AS BIGINT) AS n_pairs, (SELECT count(*) FROM gr) AS n_groups, CAST((SELECT coalesce(sum(n_members), 0) FROM gr) AS BIGINT) AS n_to_move FROM n""",
    "watched_nn_distance": f"WITH {_W} SELECT lpad(lower(to_hex(h)), 4, '0') AS hash, CAST(least(dist, 16) AS INTEGER) AS distance FROM nn",
    "metric_index_range": f"""WITH {_E}, s AS (SELECT DISTINCT h FROM eh WHERE label IN (0, 1)), q AS (SELECT DISTINCT h FROM eh WHERE label > 1)
      SELECT lpad(lower(to_hex(q.h)), 4, '0') AS hash, lpad(lower(to_hex(s.h)), 4, '0') AS seen, CAST(bit_count(xor(q.h, s.h)) AS INTEGER) AS distance FROM q JOIN s ON bit_count(xor(q.h, s.h)) <= 2""",
    "watched_split": f"WITH {_W} SELECT path, similarity, similarity >= 85 AS is_watched FROM sp",
    "unwatched_set": f"WITH {_W} SELECT path FROM sp WHERE similarity < 85",
    "cache_classify": f"WITH {_C} SELECT path, state FROM cl",
    "cache_stats": f"WITH {_C} SELECT count(*) FILTER (state = 'hit') AS hits, count(*) FILTER (state = 'miss') AS misses, count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'skipped') AS skipped FROM cl",
    "cache_prune": f"WITH {_C} SELECT oc.path, status, oc.mtime, num_frames FROM oc JOIN ls USING (path)",
    "cache_upsert": f"""WITH {_C} SELECT oc.path, oc.status, oc.mtime, oc.num_frames, 8 AS hash_size, CASE WHEN ok THEN 1 END AS n_hashes FROM oc JOIN cl USING (path) WHERE state IN ('hit', 'skipped')
      UNION ALL SELECT path, 'OK', mtime, 20, 8, 1 FROM cl WHERE state IN ('miss', 'stale')""",
    "file_listing": """WITH p AS (SELECT doc_id, ['', 'sub/', 'watched_videos/', 'sub/duplicate_videos/deep/', 'my_watched_videos/'][doc_id % 5 + 1] || CAST(doc_id AS VARCHAR) || '.' || ['mp4', 'MKV', 'txt', 'tar.mov', 'Wmv', 'mp4.part', 'flv'][doc_id % 7 + 1] AS path
      FROM documents WHERE text IS NOT NULL), n AS (SELECT *, regexp_replace(path, '^.*/', '') AS name FROM p)
      SELECT doc_id, path, name, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM n
      WHERE regexp_matches(lower(path), '\\.(mp4|avi|mkv|mov|wmv|flv)$') AND NOT regexp_matches(path, '(^|/)(duplicate_videos|watched_videos|skipped_videos)/')""",
    "watched_store": f"""WITH {_U} SELECT coalesce(n.path, o.path) AS video_id, array_to_string(list_transform(coalesce(n.hs, o.hs), lambda h: lpad(lower(to_hex(h)), 4, '0')), ',') AS hashes
      FROM o FULL JOIN n ON o.path = n.path""",
    "watched_upsert_status": f"""WITH {_U}
      SELECT coalesce(n.path, o.path) AS video_id, CASE WHEN n.path IS NULL THEN 'kept' WHEN o.path IS NULL THEN 'added' WHEN n.hs = o.hs THEN 'refreshed' ELSE 'updated' END AS status,
      CAST(len(coalesce(n.hs, o.hs)) AS INTEGER) AS n_hashes FROM o FULL JOIN n ON o.path = n.path""",
    "final_unique": f"WITH {_PAIRS} SELECT path FROM sg WHERE path NOT IN (SELECT a FROM ed UNION SELECT b FROM ed)",
    "move_plan": """WITH f AS (SELECT '/media/' || source || '/' || lang || '_' || CAST(doc_id % 50 AS VARCHAR) || 'x.mp4' AS src, lang || '_' || CAST(doc_id % 50 AS VARCHAR) || 'x' AS root, doc_id FROM documents),
      n AS (SELECT src, root, row_number() OVER (PARTITION BY root ORDER BY doc_id, src) - 1 AS k FROM f)
      SELECT src, CASE WHEN k <= 100 THEN '/media/duplicate_videos/' || root || CASE WHEN k > 0 THEN '_' || CAST(k AS VARCHAR) ELSE '' END || '.mp4' END AS dest, 'move' AS action, CASE WHEN k <= 100 THEN 'planned' ELSE 'failed' END AS status FROM n""",
    "inspect_db": "SELECT count(*) AS n_videos, 4 AS num_frames, 4 AS hash_size FROM embeddings WHERE label = 0 AND len(embedding) = 64",
}
ORACLE_SQL["cache_store"] = ORACLE_SQL["cache_upsert"]
