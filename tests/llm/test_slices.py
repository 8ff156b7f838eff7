import numpy as np
import pyarrow as pa
from twinframe.llm.language_model import LogBilinear
from twinframe.llm.packing import Encoder
from twinframe.llm.queries import tokenizer
from twinframe.llm.slices import slices


def test_slices_hold_all_rows_in_bounds():
    texts = [None, "", "a" * 10, "b" * 500, "c", "é" * 30, None] * 9
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, type=kind)], ["t"])
        parts = list(slices(batch, "t", 5, 100))
        assert [x for p in parts for x in p.column("t").to_pylist()] == texts
        assert all(p.num_rows <= 5 and (p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column("t").to_pylist()) <= 100) for p in parts)
    assert list(slices(batch.slice(0, 0), "t", 5)) == []
    inner = batch.slice(3, 4)
    assert [x for p in slices(inner, "t", 2, 50) for x in p.column("t").to_pylist()] == texts[3:7]


def test_encoder_tables_are_bounded_by_bytes():
    encoder = Encoder(tokenizer("byte_bpe_50k.json"), remember=4000)
    text = " ".join([*(f"word{i}" for i in range(500)), "x" * 5000])
    for t in (text, text[::-1], "x" * 5000):
        assert encoder.ids(t) == np.array(encoder.whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        held = [(k, v) for d in (encoder.first, encoder.later) for k, v in d.items()]
        assert sum(encoder.ENTRY + len(k) + len(v) for k, v in held) <= encoder.held <= 4000
        assert all(len(k) <= encoder.LONG for k, _ in held)


def test_shared_contexts_have_the_plain_probabilities():
    rng, n = np.random.RandomState(3), 200
    for scale in (1, 40):
        model = LogBilinear.fresh(rng.randint(1, 90, n), 8)
        for x in model.tables():
            x += rng.normal(0, 0.3 * scale, x.shape).astype(np.float32)
        target, one, two = rng.randint(0, n, 3000), rng.randint(0, 6, 3000) * 40, rng.randint(0, 3, 3000)
        one[:20] = n
        got = model.log_probability(target, one, two, at_once=64, block=1000)
        q = np.concatenate((model.q1[one] + model.q2[two], np.ones((3000, 1))), axis=1).astype(float)
        soft = lambda s: s - s.max(axis=1, keepdims=True) - np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
        groups = soft(q @ model.groups.T.astype(float))
        for i in range(0, 3000, 7):
            g = target[i] // model.per
            units = soft(q[i : i + 1] @ model.r[g * model.per : (g + 1) * model.per].T.astype(float))[0]
            want = groups[i, g] + units[target[i] - g * model.per]
            assert abs(got[i] - want) < 1e-3 * max(1, abs(want))
