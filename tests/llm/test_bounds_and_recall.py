"""Memory of operator 6 in bytes, words without end, and operator 9's recall at the lengths that tables have."""

import math
import random

import numpy as np
import pytest

from twinframe.llm import embedding_dedup, sentencepiece_codec
from twinframe.llm.queries import tokenizer

MODEL = "piece_bpe_32k.model"


def test_words_are_forgotten_by_their_bytes():
    """Distinct long words: the table never holds more than its bound and one part's words."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("etaoinshr") for _ in range(400)) for _ in range(5)) for _ in range(60)]
    c = sentencepiece_codec.Codec(tokenizer(MODEL), remember=20_000)
    most = 0
    for k in range(0, len(texts), 4):
        got = c.encode(texts[k : k + 4])
        assert got == [np.array(c.library.encode(t), "<i4").tobytes() for t in texts[k : k + 4]]
        held = sum(len(w) + len(i) for d in (c.marked, c.whole) for w, i in d.items())
        assert held <= c.held
        most = max(most, held)
    part = max(sum(len(t) + 4 * len(c.library.encode(t)) for t in texts[k : k + 4]) for k in range(0, len(texts), 4))
    assert most <= 20_000 + part
    assert 0 < len(c.marked) + len(c.whole) < 5 * len(texts)


@pytest.mark.parametrize("text", ["ab" * 100_000, "梦" * 50_000, "x" * 100_000 + " y", " " * 50_000 + "z", "https://" + "a1/" * 60_000])
def test_words_without_spaces_of_any_length(text):
    c = sentencepiece_codec.Codec(tokenizer(MODEL))
    got = c.encode([text, "a b"])
    assert got[0] == np.array(c.library.encode(text), "<i4").tobytes()
    assert c.decode(got[0]) == text


def test_encoding_in_parts_of_batches(spark):
    """Texts that are longer than a part, beside short, empty and null ones; ids and their order are the rows'."""
    texts = ["word " * 300_000, None, "", "short text", "é" * 30, *("line %d\nnext" % k for k in range(1200))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    c = sentencepiece_codec.Codec(tokenizer(MODEL))
    got = sentencepiece_codec.encode(df, tokenizer(MODEL)).collect()
    assert [r.doc_id for r in got] == list(range(len(texts)))
    for r in got:
        assert r.ids == c.library.encode(texts[r.doc_id] or "") and r.n_pieces == len(r.ids) and r.round_trip


@pytest.mark.parametrize("dim", [3, 48, 64, 100, 384, 768])
def test_pairs_at_the_threshold_meet(dim):
    """Cosine 0.95 exactly, the hardest pairs that count."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(600, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * z
    a, b = (embedding_dedup.buckets(v, 3, 3, 8) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert met.mean() > 0.97
