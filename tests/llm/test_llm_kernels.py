"""Parts of the operators that need no Spark, against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from twinframe.llm import embedding_dedup, html_text, language_model, packing, sentencepiece_codec, simhash, topk_search, toxicity
from twinframe.llm.blocks import forest
from twinframe.llm.queries import tokenizer

ODD = ["", " ", "  ", "a  b", "   b", " a", "a ", "\n a\n\n b", "x \n y", "a<|endoftext|>b", "é b\x1c c", "😀 hi", "1234 5", "\t\ta", "don't we'll", " \n \n b", "a\n", "a" + " " * 11 + "b", "Straße œuvre 梦 ﬁ", "A$$$ An%%% And&&&", " x"]


def some_texts(n=60, seed=1):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    return random.Random(seed).sample(texts, n)


def test_encoder_gives_the_librarys_ids():
    e = packing.Encoder(tokenizer("byte_bpe_50k.json"), remember=500)
    for t in ODD + some_texts():
        assert np.frombuffer(e.ids(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids


def test_cutting():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]
    assert packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


@pytest.mark.parametrize("seed", range(12))
def test_packing_places_everything_once(seed):
    rng = random.Random(seed)
    cap = rng.choice((10, 30, 1024))
    sizes = [rng.randint(1, rng.choice((cap, max(1, cap // 3)))) for _ in range(rng.choice((1, 7, 400)))]
    hist = Counter(sizes)
    patterns = packing.plan_bins(hist, cap)
    assert Counter(s for p, n in patterns for s in p for _ in range(n)) == hist
    assert all(sum(p) <= cap and sum(3 * s > cap for s in p) <= 2 for p, _ in patterns)
    slots = packing.Slots(patterns)
    where = {}
    for s, n in hist.items():
        seq, off = slots.place(np.full(n, s), np.arange(n))
        for q, o in zip(seq.tolist(), off.tolist(), strict=True):
            where.setdefault(q, []).append((o, s))
    for spans in where.values():
        at = 0
        for o, s in sorted(spans):
            assert o == at
            at += s
        assert at <= cap
    bound = max(math.ceil(sum(sizes) / cap), sum(2 * s > cap for s in sizes))
    assert bound <= len(where) <= 1.25 * bound + 1


def test_large_items_are_matched_as_well_as_can_be():
    for seed in range(40):
        rng = random.Random(seed)
        sizes = [rng.randint(11, 30) for _ in range(8)]

        def most(left):
            if len(left) < 2:
                return 0
            a, rest = left[0], left[1:]
            return max([most(rest), *(1 + most(rest[:i] + rest[i + 1 :]) for i, b in enumerate(rest) if a + b <= 30)])

        assert sum(n for _, n in packing.plan_bins(Counter(sizes), 30)) == len(sizes) - most(sizes)


def test_sentencepiece_gives_the_librarys_ids_and_texts():
    c = sentencepiece_codec.Codec(tokenizer("piece_bpe_32k.model"), remember=2000)
    texts = ODD + some_texts()
    for t, got in zip(texts, c.encode(texts, at_once=20), strict=True):
        assert np.frombuffer(got, "<i4").tolist() == c.library.encode(t), t
        assert c.decode(got) == t


def test_sentencepiece_forward_pass_of_a_unigram_model(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    rng = random.Random(2)
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0, type=kind)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)} | set("abc"))
    for p in ["▁", *pieces, *("▁" + x for x in pieces[::2])]:
        m.pieces.add(piece=p, score=-rng.uniform(1, 9), type=1)
    m.trainer_spec.model_type, m.normalizer_spec.name = 1, "identity"
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    path = str(tmp_path / "u.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    c = sentencepiece_codec.Codec(path)
    texts = [" ".join("".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 9))) for _ in range(6)) for _ in range(60)]
    for t, got in zip(texts, c.encode(texts), strict=True):
        score = lambda ids: sum(c.score[i] if i else c.worst for i in ids)
        mine, theirs = np.frombuffer(got, "<i4").tolist(), c.library.encode(t)
        assert "d" in t or score(mine) == pytest.approx(score(theirs), abs=1e-4)


def simhash_by_definition(text, n=4):
    words = text.lower().split() if text else []
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in ["", " ", "One", "One two", "A b c d", "É b c d e f b c d e", "x\x0by\x0cz w\r\nv", *some_texts(20)]:
        assert simhash.fingerprint(t.encode()) == simhash_by_definition(t.encode())


def test_segments_cover_any_distance():
    for m, s in ((4, 3), (4, 4), (4, 5), (3, 2), (0, 1), (2, 8)):
        plan = simhash.segment_plan(m, s)
        assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for *_, r in plan) == m + 1
        assert [a for a, *_ in plan] == list(itertools.accumulate([0, *(w for _, w, _ in plan)]))[:-1]


def test_forest():
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert forest(linked).tolist() == [0, 1, 1, 0, 4, 0]


def test_rotation_keeps_lengths_and_recall_is_high():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * z
    a, b = (embedding_dedup.buckets(v, 3, 3, 8) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert met.mean() > 0.98


@pytest.mark.parametrize("seed", range(25))
def test_impact_index_is_exact(seed):
    rng = np.random.default_rng(seed)
    n, d, hi = rng.choice([1, 5, 30, 700]), rng.integers(1, 9), rng.choice([1, 3, 1000])
    x, ids = rng.integers(-hi, hi + 1, (n, d)), np.arange(n) * 3
    index = topk_search.ImpactIndex(ids, x)
    for t in range(12):
        q = rng.integers(-hi, hi + 1, d) * (t > 0)
        skip = int(ids[rng.integers(n)]) if t % 2 else None
        keep = ids != skip if skip is not None else np.ones(n, bool)
        score = x @ q
        order = np.lexsort((ids[keep], -score[keep]))[:10]
        got = index.search(q, 10, skip)
        assert np.array_equal(got[0], ids[keep][order]) and np.array_equal(got[1], score[keep][order])


def text_of(page):
    return " ".join(x.text for x in html_text.candidates(html_text.lines(page)))


def test_main_text():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>'
        '<div class="cookie-notice">We use</div><article><h1>Head &amp; line</h1><p><b>One\n  two<br>three<p>a &lt; b&nbsp;c<!-- no --></p><aside>More</aside><ul><li>x<li>y</ul>'
        '<form><label>Mail</label></form><div class="ad">Buy</div></article><section id="comments"><article><p>First!</p></article></section><aside class="sidebar">S</aside><footer>&copy; F</footer>'
    )
    assert text_of(page) == "Head & line One two three a < b c x y"
    assert text_of("") == text_of("<p>") == text_of("<script>a") == ""
    assert text_of("<p>a &am") == "a &am" and text_of("a < b") == "a < b" and text_of("<p>a</p><p>b<") == "a b<"
    assert text_of("<nav>m<article><p>x</p></article>") == "x"


def test_alignment_is_a_longest_common_subsequence():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = html_text.shared(a, b)
        assert sum(got) == lcs(a, b)
        it = iter(b)
        assert all(x in it for x, s in zip(a, got, strict=True) if s)


def test_model_probabilities_sum_to_one():
    u = language_model.Units([b"a", b"b", b"c"], 4)
    m = language_model.LogBilinear.fresh(np.array([5.0, 3, 2, 4, 1, 1, 1, 1]), 3)
    t, sizes = u.sequence([b"a b zz!", None, b"C a"])
    assert sizes.tolist() == [4, 1, 3] and t.tolist()[-3:] == [2, 0, 3]
    one, two = u.context(t, sizes)
    assert one.tolist()[4] == two.tolist()[5] == u.start
    n = len(m.r)
    for a, b in ((0, 1), (u.start, u.start), (n - 1, 2)):
        p = np.exp(m.log_probability(np.arange(n), np.full(n, a), np.full(n, b)))
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_training_helps():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(s) for _ in range(30)).encode() for s in (["a", "b"], ["c", "d"]) * 60]
    u = language_model.Units([b"a", b"b", b"c", b"d"], 2)
    t, sizes = u.sequence(texts)
    one, two = u.context(t, sizes)
    counts = np.bincount(t, minlength=u.size).astype(float)
    m = language_model.LogBilinear.fresh(counts, 4)
    before, state = m.log_probability(t, one, two).mean(), None
    m.z = None
    for e in range(6):
        state = m.train(t, one, two, (counts + 0.5) / (counts + 0.5).sum(), batch=256, seed=e, state=state)
    assert m.log_probability(t, one, two).mean() > before + 0.3


def test_toxicity_words_lose_punctuation_at_their_ends():
    assert toxicity.words("SCUM!! scum, don't (x)  -- \n") == {"scum", "don't", "x"}
    assert toxicity.words(None) == toxicity.words("") == toxicity.words("!!! --") == set()


def test_toxicity_learns_marks_of_words():
    rng = random.Random(3)
    syllables = ["ba", "de", "gi", "ko", "lu", "ma", "ne", "ri"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts, y = [], []
    for i in range(240):
        ws = [word() for _ in range(rng.randint(20, 200))]
        if i % 2:
            for _ in range(max(3, len(ws) // 50)):
                ws[rng.randrange(len(ws))] = "zux" + word()
        texts.append(" ".join(ws)), y.append(i % 2)
    n = [Counter(), Counter()]
    for t, k in zip(texts[:160], y[:160], strict=True):
        n[k].update(toxicity.words(t))
    counts = np.ones((2, 1 << 14))
    for k in (0, 1):
        for w, c in n[k].items():
            np.add.at(counts[k], toxicity.grams(w, (1 << 14) - 1), c)
    share = counts / counts.sum(axis=1, keepdims=True)
    model = toxicity.Model(*toxicity._regress(texts[:160], np.array(y[:160]), np.log(share[1]) - np.log(share[0])))
    got = model.score_texts([*texts[160:], None, ""])
    assert sum((s >= 0.5) == bool(k) for s, k in zip(got, y[160:], strict=False)) >= 76
    assert got[-1] == got[-2] and 0 <= got[-1] <= 1



def test_long_runs_of_white_space_are_encoded():
    """Like the library, and in time that grows about as their length does."""
    import time

    from sentencepiece import SentencePieceProcessor

    from twinframe.llm.sentencepiece_codec import Codec

    path = tokenizer("piece_bpe_32k.model")
    codec, sp = Codec(path), SentencePieceProcessor(model_file=path)
    texts = [f"a{' ' * n}b" for n in (2, 3, 5, 17, 64, 1000, 3001)] + [" " * 100_000, f"x \n{' ' * 777}\n y  z{' ' * 40}"]
    began = time.process_time()
    got = codec.encode(texts)
    assert time.process_time() - began < 30
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, dtype="<i4").tolist() == sp.encode(t) and codec.decode(g) == t
