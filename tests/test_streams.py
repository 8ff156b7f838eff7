"""What streams keep, against the same work done at once."""

import random
import time

import pytest
from test_operators import signatures
from test_runs import P, media

from twinframe.operators.components import add_edges, connected_components
from twinframe.operators.groups import group_members
from twinframe.operators.similarity import similar_classes
from twinframe.params import Params
from twinframe.plans import runs
from twinframe.sources import versions
from twinframe.sources.decode import ArrayMedia
from twinframe.sources.listing import stream_media
from twinframe.streaming.groups_stream import maintain_groups, read_groups, update


def test_components_after_new_edges(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    frame = lambda e: spark.createDataFrame(e, "src long, dst long")
    now = spark.createDataFrame([], "node long, component long")
    for k in range(0, 60, 20):
        now = add_edges(now, frame([*edges[k : k + 20], (None, 3), (5, 5)]))
        want = {tuple(r) for r in connected_components(frame(edges[: k + 20])).collect()}
        assert {tuple(r) for r in now.collect()} == want


def groups(rows):
    return sorted((r["group_id"], r["path"]) for r in rows.collect())


def at_once(spark, sig, p):
    classes, pairs = similar_classes(signatures(spark, sig), p)
    return groups(group_members(classes, pairs))


def test_batches_give_the_groups_of_all(spark, tmp_path):
    rng, p, at = random.Random(4), Params(2, 8, 95.0), f"{tmp_path}/groups"
    base = [[rng.getrandbits(60) for _ in range(2)] for _ in range(6)]
    sig = {}
    for i in range(70):
        h = list(rng.choice(base)) if rng.random() < 0.8 else [rng.getrandbits(60) for _ in range(2)]
        for _ in range(rng.choice((0, 0, 2, 5))):
            h[rng.randrange(2)] ^= 1 << rng.randrange(60)
        sig[f"{rng.randrange(1000):03}-{i}"] = h
    names = list(sig)
    for k in (10, 11, 40, 70):
        update(spark, at, signatures(spark, {n: sig[n] for n in names[max(0, k - 30) : k]}), p)  # batches overlap
        assert groups(read_groups(spark, at)) == at_once(spark, {n: sig[n] for n in names[:k]}, p)
    before = versions.current(spark, at).number
    changed = {names[3]: [1, 2], names[50]: list(sig[names[0]])}
    update(spark, at, signatures(spark, changed), p)
    assert groups(read_groups(spark, at)) == at_once(spark, sig | changed, p) and versions.current(spark, at).number == before + 1


def test_a_folder_is_followed(spark, tmp_path):
    folder, at = tmp_path / "in", f"{tmp_path}/groups"
    folder.mkdir()

    def follow():
        time.sleep(0.6)
        files = stream_media(spark, str(folder), True, lag=0.3)
        maintain_groups(files, at, P, str(tmp_path / "checkpoint"), ArrayMedia).awaitTermination(120)
        return groups(read_groups(spark, at))

    media(folder / "a.mp4", 1)
    media(folder / "short.mov", 3, n=100)
    assert follow() == []
    media(folder / "sub" / "b.mkv", 1, noise=0.01)
    media(folder / "c.avi", 2)
    a, b, c = (str(folder / x) for x in ("a.mp4", "sub/b.mkv", "c.avi"))
    assert follow() == [(a, a), (a, b)]
    media(folder / "c.avi", 1)  # another content
    assert follow() == [(a, a), (a, c), (a, b)]
    sig, _ = runs.hash_folder(spark, str(folder), P, True, open_media=ArrayMedia)
    classes, pairs = similar_classes(sig, P)
    assert groups(group_members(classes, pairs)) == groups(read_groups(spark, at))
    held = versions.current(spark, at)
    assert follow() and versions.current(spark, at) == held  # nothing came


@pytest.mark.parametrize("lag", [0.0, 1000.0])
def test_batches_end_before_the_lag(spark, tmp_path, lag):
    media(tmp_path / "in" / "a.mp4", 1)
    time.sleep(0.1)
    files = stream_media(spark, str(tmp_path / "in"), lag=lag)
    q = files.writeStream.format("memory").queryName(f"seen_{int(lag)}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table(f"seen_{int(lag)}").count() == (lag == 0.0)
