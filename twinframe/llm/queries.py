"""One query for each operator, with production parameters and over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import decontamination, embedding_dedup, filter_audit, html_text, language_model, licenses, line_dedup, packing, sentencepiece_codec, simhash, spelling_variants, topk_search, toxicity

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"


def tokenizer(name: str) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZERS, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_paragraphs", F.array_join("licenses", ",").alias("licenses"), F.array_join("paragraphs", ",").alias("paragraphs"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    lines = F.coalesce(F.size(F.split("text", "\n")) + F.size("removed_lines"), F.lit(0))
    # A text that lost all its lines is left empty, not with an empty line.
    lost_all = (F.col("text") == "") & (F.size("removed_lines") > 0)
    return out.select(
        "doc_id", F.when(lost_all, F.size("removed_lines")).otherwise(lines).cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_scores(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), keep_ids=False)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.find_hits(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_best_fit_packing, op3_line_dedup, op4_page_text, op5_lm_scores, op6_sentencepiece, op7_top_k, op8_toxicity, op9_embedding_dedup, op10_simhash,
        op11_decontamination, op12_filter_audit, op13_spelling_variants)
}

#: Every run of lines with 50 words that is no longer than it must be, by its text; all occurrences but the first go.
LINE_DEDUP_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS raw FROM docs WHERE length(text) > 0
), counted AS (
  SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM lines
), sized AS (
  SELECT doc_id, pos, line, CASE WHEN line = '' THEN 0 ELSE len(string_split_regex(line, '\s+')) END AS words FROM counted
), summed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM sized
), runs AS (
  SELECT a.doc_id, a.pos AS s, b.pos AS e
  FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.pos >= a.pos
  WHERE b.upto - a.upto + a.words >= 50 AND (b.upto - b.words - a.upto + a.words < 50 OR b.upto - a.upto < 50)
), texts AS (
  SELECT doc_id, list(line ORDER BY pos) AS ls FROM sized GROUP BY doc_id
), keyed AS (
  SELECT r.doc_id, r.s, r.e, md5(array_to_string(list_slice(t.ls, r.s + 1, r.e + 1), chr(10))) AS k FROM runs r JOIN texts t USING (doc_id)
), later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM keyed) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM later
), lost AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
  coalesce(lost.removed, '') AS removed, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(kept.text, '')) END AS text_md5
FROM docs d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""

#: Windows of ten words, or of a whole shorter item; a document's words inside any occurrence are hit.
DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS g FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM bk)),
dg AS (SELECT r, i, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS g FROM (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS i FROM dw, (SELECT DISTINCT k FROM bk) WHERE len(w) >= k)),
hit AS (SELECT r, i, k, item_id FROM dg JOIN bg USING (k, g)),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
own AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(own.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, pos.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN own USING (r)
"""

FILTER_AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 200 AS INT) AS fa, CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) AS fb,
  CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS INT) AS fc, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS fd,
  CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS fe FROM t LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fa + 2 * fb + 4 * fc + 8 * fd + 16 * fe AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
ltr AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
ord AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM ltr a, ltr b, ltr c, ltr d, ltr e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
st AS (SELECT o, s, 1 << (ascii(o[s]) - 65) AS own, coalesce(list_sum([1 << (ascii(c) - 65) FOR c IN string_split(o[1:s - 1], '') IF c <> '']), 0) AS prior FROM ord, (SELECT unnest(range(1, 6)) AS s)),
r AS (SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, own, sum(CASE WHEN mask & (own | prior) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & prior = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & prior <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & prior = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & prior = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, st GROUP BY part, o, s, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

#: The checksum byte by byte; two words are near if a third string with a gap fits both.
SPELLING_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM o WHERE length(run) >= 7 GROUP BY doc_id, run),
b AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes FROM c),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(bytes AS BIGINT[])), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]))) AS h FROM b, tab),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS (SELECT word, n, p, substring(word, 1, p) AS a, substring(word, p + 2) AS z FROM (SELECT *, unnest(range(length(word))) AS p FROM w)),
e AS (SELECT x.word, y.word AS other, y.n FROM g x JOIN g y ON x.p = y.p AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g.a || g.z UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g.a || g.z),
s AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS near, max(n) AS near_n FROM e GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN s USING (word)),
r AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM f UNION ALL SELECT r.word, coalesce(f.form, f.word), f.form IS NULL FROM r JOIN f ON f.word = r.root WHERE NOT done)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN r ON r.word = f.word AND r.done
"""

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": LINE_DEDUP_SQL, "op7_top_k": TOP_K_SQL, "op9_embedding_dedup": EMBEDDING_SQL,
    "op11_decontamination": DECONTAMINATION_SQL, "op12_filter_audit": FILTER_AUDIT_SQL, "op13_spelling_variants": SPELLING_SQL,
}
