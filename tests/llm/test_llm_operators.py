"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import embedding_dedup, html_text, language_model, licenses, line_dedup, packing, queries, sentencepiece_codec, simhash, topk_search, toxicity
from twinframe.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rep long, word string, key long"


def word(rng):
    return "".join(rng.choice(("ka", "lo", "mi", "tu", "se")) for _ in range(rng.randint(1, 3)))


def passage(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    shared, short = passage(rng, 60), passage(rng, 12)
    out = [(0, None), (1, ""), (2, " \n\t\n"), (None, passage(rng, 20)), (None, None)]
    for i in range(3, 40):
        lines = [passage(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), shared)
        if i % 3 == 0:
            lines.insert(0, short)
        if i % 11 == 0:
            lines.append("Released under the MIT License.")
        out.append((i, "\n".join(lines)))
    text = out[10][1]
    out += [(50, text), (51, text), (51, text), (52, text + "\n" + passage(rng, 30)), (53, "\n".join([passage(rng, 5)] * 30)), (54, passage(rng, 9000)), (55, shared + "\n" + shared + "\n" + short)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "en", None if i == 5 else "s", len(t or ""), 1, 2, "w", 3) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(a) for a in range(n)]


def test_simhash(docs, rows, empty):
    from test_llm_kernels import simhash_by_definition

    fps = [simhash_by_definition((t or "").encode()) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    comp, least = components(len(rows), links), defaultdict(list)
    for k, (i, _) in zip(comp, rows, strict=True):
        if i is not None:
            least[k].append(i)
    want = Counter((i, f"{f:016x}", min(least[k], default=None)) for (i, _), f, k in zip(rows, fps, comp, strict=True))
    for bucket in (64, 1):  # with and without the path of large buckets
        assert Counter(map(tuple, simhash.simhash_near_dedup(docs, bucket=bucket).collect())) == want
    assert simhash.simhash_near_dedup(empty).count() == 0


def test_hamming_links_lose_none(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(8)]
    fps = set(base)
    for _ in range(160):
        f = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        fps.add(f)
    fps = sorted(fps)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(signed, "rep long, fp long")
    want = components(len(fps), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    for segments, bucket, block in ((3, 64, 2048), (3, 2, 8), (5, 8, 16)):
        links = [(r.src, r.dst) for r in simhash.hamming_links(df, 4, segments, bucket, block).collect()]
        assert components(len(fps), links) == want


def check_packing(out, rows, cap):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(packing.cut(len(ids), cap)):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= cap
    return len(seqs)


def test_packing(docs, rows, empty):
    out = packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), 64, keep_ids=True).collect()
    n = check_packing(out, rows, 64)
    assert n <= math.ceil(sum(r.length for r in out) / 64) * 1.05 + 1
    assert all(len(r.ids) == r.length for r in out)
    assert packing.pack_documents(empty, tokenizer("byte_bpe_50k.json")).count() == 0


def test_sentencepiece(docs, rows, empty):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    out = sentencepiece_codec.encode(docs, path)
    got = out.collect()
    assert Counter((r.doc_id, tuple(r.ids), r.round_trip) for r in got) == Counter((i, tuple(sp.encode(t or "")), True) for i, t in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<i4").tobytes()) and r.n_pieces == len(r.ids) for r in got)
    assert Counter((r.doc_id, r.text) for r in sentencepiece_codec.decode(out, path).collect()) == Counter((i, t or "") for i, t in rows)
    assert sentencepiece_codec.encode(empty, path).count() == 0


def test_line_dedup(docs, rows, empty):
    """Against SQL on rows told apart by id (the SQL has no row identity), and by what must be true of copies."""
    once = [(i, t) for i, t in dict(rows).items() if i is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", once)
    want = {r[0]: (r[2], r[3]) for r in con.sql(queries.LINE_DEDUP_SQL).fetchall()}
    out = line_dedup.line_dedup(docs.filter("doc_id is not null")).collect()
    for r in out:
        assert (len(r.removed_lines), ",".join(map(str, r.removed_lines))) == want[r.doc_id], r.doc_id
        if r.text is not None:
            lines = dict(once)[r.doc_id].split("\n")
            assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in r.removed_lines)
    assert [r.doc_id for r in out].count(51) == 2 and all(len(r.removed_lines) for r in out if r.doc_id in (51, 55))
    assert not any(r.removed_lines for r in out if r.doc_id in (0, 1, 2, 4, 9))
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.line_dedup(docs).count() == len(rows)


def test_line_dedup_of_overlapping_and_short_lines(spark):
    rng = random.Random(3)
    alphabet = [passage(rng, k) for k in (1, 2, 4, 9, 20, 60)] + ["", "  "]
    data = [(i, "\n".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25)))) for i in range(30)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    want = {r[0]: r[3] for r in con.sql(queries.LINE_DEDUP_SQL).fetchall()}
    got = line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: ",".join(map(str, r.removed_lines)) for r in got} == want


def test_licenses(spark, docs, rows, empty):
    extra = [(100 + k, f"{passage(random.Random(k), 20)}\n{t[0]}") for k, t in enumerate(licenses.TEMPLATES.values())]
    more = docs.select("doc_id", "text", "word").unionByName(spark.createDataFrame([(i, t, "w") for i, t in extra], "doc_id long, text string, word string"))
    got = licenses.license_scan(more).collect()
    by = {r.doc_id: r.licenses for r in got if r.doc_id is not None}
    assert len(got) == len(rows) + len(extra)
    assert {i: by[100 + k] for k, i in enumerate(licenses.TEMPLATES)} == {i: [i] for i in licenses.TEMPLATES}
    assert {i for i in by if by[i] and i < 100} == {i for i, t in rows if i is not None and "MIT License" in (t or "")}
    assert licenses.license_scan(empty).count() == 0
    # What is found does not hang on how common licences are in the corpus.
    exact = licenses.TEMPLATES["mit"][2]
    prose = [(k, passage(random.Random(900 + k), 25)) for k in range(50)]
    for copies in (1, 40):
        df = spark.createDataFrame([*prose, *((100 + k, exact) for k in range(copies)), (300, exact.replace("free", "free of all"))], "doc_id long, text string")
        assert {r.doc_id for r in licenses.license_scan(df).collect() if r.licenses == ["mit"]} == {300, *range(100, 100 + copies)}


def brute_links(vecs):
    n = len(vecs)
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vecs]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    return [(a, b) for a, b in itertools.combinations(range(n), 2) if ok[a] and ok[b] and len(vecs[a]) == len(vecs[b]) and cos(vecs[a], vecs[b]) >= 0.95]


def test_embedding_dedup(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    vecs = [(centre[i % 12] + 0.08 * rng.normal(size=16)).tolist() for i in range(90)]
    vecs += [vecs[0], vecs[0], [2 * x for x in vecs[1]], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    data = [(i, v, 1, 2) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n long, rep long")
    links = brute_links(vecs)
    comp, deg = components(len(vecs), links), Counter(x for p in links for x in p)
    want = {i: (deg[i], comp[i], comp[i] == i) for i in range(len(vecs))}
    for block in (1024, 8):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dedup(df, block=block).collect()}
        assert got == want
    assert embedding_dedup.embedding_near_dedup(df.limit(0)).count() == 0
    odd = embedding_dedup.embedding_near_dedup(df.limit(3).unionByName(df.limit(1).withColumn("vec_id", F.lit(None).cast("long")))).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in odd if r.vec_id is None] == [(0, None, False)]


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vecs = [rng.normal(0, 0.1, 8).tolist() for _ in range(230)]
    vecs[7], vecs[9], vecs[200], vecs[11] = None, [float("inf")] * 8, None, vecs[10]
    data = [(i, v, "x") for i, v in enumerate(vecs)] + [(10, vecs[10], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string")
    x = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in enumerate(vecs) if v is not None and np.isfinite(v).all()}
    want = set()
    for q in (i for i in x if i % 100 == 0):
        best = sorted(((-int(x[q] @ x[i]), i) for i in x if i != q))[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    for shard in (8192, 30):
        assert set(map(tuple, topk_search.top_k(df, shard=shard).collect())) == want
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_page_text(spark):
    frame = lambda body, k: f"<html><body><div>Site of the year</div><div>Home About Contact</div>{body}<div>Copyright the site {k % 2}</div></body></html>"
    rng = random.Random(8)
    data = [(k, f"http://a.example/en/{k}?q={k}", frame(f"<p>{passage(rng, 30)}</p><p>{passage(rng, 20)}</p>", k), 1) for k in range(25)]
    data += [(100, "http://b.example/x", "<article><h1>T</h1><p>one</p></article>", 1), (101, "http://b.example/x/", "<article><h1>T</h1><p>one</p></article>", 1), (102, None, None, 1), (103, "odd", "", 1), (103, "odd", "", 1)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, text int")
    got = {}
    for r in html_text.extract_text(df).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id] = r.text
    for k in range(25):  # two neighbours share the lines around the text, and one or none its last
        body = data[k][2].split("</div>", 2)[2].split("<div>")[0]
        assert got[k].startswith(" ".join(x.split("</p>")[0] for x in body.split("<p>")[1:])), got[k]
        assert "Site of" not in got[k] and "Home" not in got[k]
    assert got[100] == got[101] == "T one" and got[102] == got[103] == ""
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_language_model(docs, rows, empty):
    out = language_model.lm_scores(docs, frequent=10, classes=8, head=15, dim=4, warm=10).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = lambda t: [*(t or "").lower().split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        ws = toks(t)
        want[i, held(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert language_model.lm_scores(empty).count() == 0


def test_language_model_scores_by_definition(docs, rows):
    """Each token's probability as the product of two softmaxes and, in a class, the word's share."""
    options = dict(frequent=10, classes=8, head=15, dim=4, warm=10, least=3)
    src = docs.select(language_model.held_out("doc_id").alias("h"), F.col("text").cast("binary").alias("text"))
    scorer, counts = language_model.fit(src.filter("not h").select("text"), **options)
    n = {bytes(r.word): r.n for r in counts.collect()}
    u, m = scorer.units, scorer.model
    shares = [Counter() for _ in range(8)]
    for w, c in n.items():
        if u[w] > u.end:
            shares[u[w] - u.end - 1][w] = c

    def soft(table, q, k):
        s = table[:, :-1].astype(float) @ q + table[:, -1]
        return s[k] - math.log(sum(math.exp(x) for x in s))

    def score(text):
        ws, before, total = [*language_model.words((text or "").encode()), language_model.END], [u.start, u.start], 0.0
        for w in ws:
            k = u[w]
            q = m.q1[before[-1]].astype(float) + m.q2[before[-2]]
            g = k // m.per
            p = soft(m.r[g * m.per : (g + 1) * m.per], q, k - g * m.per) + (soft(m.groups, q, g) if len(m.groups) > 1 else 0.0)
            if k > u.end:
                c = shares[k - u.end - 1]
                p += math.log((c[w] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1)))
            total += p / math.log(10)
            before.append(k)
        return total

    some = [(i, t) for i, t in rows if i is not None and i < 30]
    got = {r.doc_id: r.score for r in language_model.lm_scores(docs, **options).collect()}
    for i, t in some:
        assert abs(got[i] - score(t)) < 1e-3 + 1e-4 * abs(got[i]), i


def test_toxicity(spark, docs, rows, empty):
    rng = random.Random(9)
    data = [(200 + i, " ".join([passage(rng, 30), *(["zuxa zuxo zuxlo"] if i % 3 == 0 else [])])) for i in range(150)]
    labels = spark.createDataFrame([(i, int(k % 3 == 0), 1) for k, (i, _) in enumerate(data)] + [(999, 1, 1), (None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, toxic int, quality int")
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(data, "doc_id long, text string"))
    out = toxicity.toxicity_scores(df, labels).collect()
    assert len(out) == len(rows) + len(data) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.doc_id for r in out if r.held_out} == {i for i, _ in rows + data if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r.predicted == ((r.doc_id - 200) % 3 == 0) for r in out if (r.doc_id or 0) >= 200]
    assert sum(right) > 0.97 * len(right)
    # With fewer labels than there are, the classes' proportions stay those of all.
    model = toxicity.fit(df, labels, labelled=40, sample=30)
    out = toxicity.score(df, model).filter("doc_id >= 200").collect()
    assert sum((r.toxicity >= 0.5) == ((r.doc_id - 200) % 3 == 0) for r in out) > 0.9 * len(out)
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert all(r.score < 1e-6 for r in toxicity.toxicity_scores(df, labels.limit(0)).collect())


def toxic_by_definition(model, text):
    """The probability from the model's weights, gram by gram."""
    ws = {w.strip(toxicity.PUNCTUATION) for w in (text or "").lower().split()} - {""}
    z = 0.0
    for w in ws:
        marked = f" {w} "
        z += model.per_word + sum(float(model.weights[zlib.crc32(marked[i : i + n].encode()) % len(model.weights)]) for n in toxicity.ORDERS for i in range(len(marked) - n + 1))
    return 1 / (1 + math.exp(-(model.intercept + z / math.sqrt(max(1, len(ws))))))


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp
    from test_near_copies import kept_by_brute_force

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, schema, rows = docs.columns, docs.schema, docs.collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}

    def step(k, rows):
        out = cp.STAGES[k][1](spark, spark.createDataFrame(rows, schema), sf)
        assert out.columns == cols
        return out.collect()

    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = step(0, rows)
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in rows if toxic_by_definition(model, r.text) < 0.5)
    left = {r.doc_id for r in clean}
    known = [i for i in labels if i in {r.doc_id for r in rows}]
    assert sum((i in left) == (labels[i] == 0) for i in known) >= 0.95 * len(known)

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in clean])
    want = {r[0]: r[4] for r in con.sql(queries.LINE_DEDUP_SQL).fetchall()}
    deduped = step(1, clean)
    assert {r.doc_id: hashlib.md5(r.text.encode()).hexdigest() if r.text is not None else None for r in deduped} == want
    assert all(r.n_chars == len(r.text) for r in deduped if r.text is not None)

    deduped.sort(key=lambda r: r.doc_id)
    want = kept_by_brute_force([r.text for r in deduped])
    kept = step(2, deduped)
    assert {r.doc_id for r in kept} == {deduped[k].doc_id for k in want}
    check_packing(cp.STAGES[3][1](spark, spark.createDataFrame(kept, schema), sf).collect(), [(r.doc_id, r.text) for r in kept], 1024)


def test_columns_of_any_name_stay(spark):
    import corpus_pipeline as cp
    from twinframe.llm import near_copies

    names = ["removed_lines", "gone_lines", "gone_key1", "gone_key2", "d1", "d2", "g1_", "gone_", "toxicity", "row_", "id_", "node", "grp", "n_"]
    text = "\n".join(passage(random.Random(k), 30) for k in range(3))
    data = [(i, text if i < 3 else passage(random.Random(90 + i), 9), *range(len(names))) for i in range(6)]
    df = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"{x} int" for x in names))
    for stage in (cp.drop_repeated_lines, cp.drop_near_copies, cp.drop_toxic):
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.columns == df.columns and all(tuple(r)[2:] == tuple(range(len(names))) for r in out.collect())
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns, "removed_lines_"] and sorted(len(r.removed_lines_) for r in out.collect()) == [0, 0, 0, 0, 3, 3]
    assert {r.doc_id for r in near_copies.keep_one_of_each(df).collect()} == {0, 3, 4, 5}
