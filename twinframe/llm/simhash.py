"""SimHash near-duplicate detection by multi-index hashing (operator 10).

Fingerprints are made in Arrow batches (no shuffle). Equal fingerprints collapse to a class before
anything is joined, so exact copies cost one row however many there are. Two classes link when
their fingerprints differ in at most ``max_distance`` bits. The 64 bits are cut into segments with
radii r_i such that sum(r_i + 1) > max_distance: some segment of any linked pair then differs in at
most its r_i bits. Each class puts its segment values in a table and looks up the small Hamming
ball around them; what it meets is verified on all 64 bits. A ball is walked upwards only (bits
that are 0 in the value are set), which meets every pair once instead of twice.

Table buckets with more than ``bucket`` classes (near copies by the thousand share segment values)
do not emit pairs: their members are compared in blocks and give a spanning forest, which is all
that the components need. Nothing is capped.

Edge cases. Null text is an empty text; a text without words has fingerprint zero and links like
any other. Fewer words than ``ngram`` make one shingle. Rows with a null id have a fingerprint and
take the component of their fingerprint's class, null if no row of it has an id. Rows that repeat
an id are kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.blocks import block_pairs, forest, grouped, runs
from twinframe.operators.components import connected_components
from twinframe.sources.shared import materialize

BITS = 64


def fingerprint(text: bytes, ngram: int = 4, seed: int = 42) -> int:
    """SimHash of one text: bits set in over half of its shingles' XXH64."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(ngram, len(words))
    first, last = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    total, n = np.zeros(BITS, dtype=np.int64), len(first)
    for at in range(0, n, 1 << 16):
        part = b"".join([xxh64_digest(whole[a:b], seed) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)])
        total += np.unpackbits(np.frombuffer(part, dtype=np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, ngram: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp)``: each row's fingerprint as a signed long."""
    src = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("binary").alias("text_"))
    kind = src.schema["id_"].dataType

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [fingerprint(t, ngram) if t else 0 for t in b.column("text_").to_pylist()]
            fps = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id_"), pa.array(fps)], ["id_", "fp"])

    schema = T.StructType([T.StructField("id_", kind), T.StructField("fp", T.LongType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id_", id_col)


def segment_plan(max_distance: int, segments: int) -> list[tuple[int, int, int]]:
    """``(offset, width, radius)`` of each segment; sum(radius + 1) is max_distance + 1."""
    share = [(max_distance + 1) // segments + (i < (max_distance + 1) % segments) for i in range(segments)]
    share = [s for s in share if s]
    out, at = [], 0
    for i, s in enumerate(share):
        width = BITS // len(share) + (i >= len(share) - BITS % len(share))
        out.append((at, width, s - 1))
        at += width
    return out


def _balls(classes: DataFrame, plan) -> DataFrame:
    """Every class's table entry and the upper half of the Hamming ball around it, by segment."""

    def ball(s: int, at: int, width: int, radius: int) -> F.Column:
        key = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
        up = F.filter(F.array(*map(F.lit, masks)).cast("array<bigint>"), lambda m: key.bitwiseAND(m) == 0)
        return F.transform(up, lambda m: F.struct(F.lit(s).alias("seg"), key.bitwiseOR(m).alias("key"), (m == 0).alias("own")))

    parts = [ball(s, *p) for s, p in enumerate(plan)]
    return classes.select("rep", "fp", F.explode(F.concat(*parts)).alias("e")).select("rep", "fp", "e.seg", "e.key", "e.own")


def hamming_links(classes: DataFrame, max_distance: int = 4, segments: int = 3, bucket: int = 64, block: int = 2048) -> DataFrame:
    """Edges ``(src, dst)`` that connect all classes ``(rep, fp)`` as their links do."""
    plan = segment_plan(max_distance, segments)
    if any(r > 1 for *_, r in plan):
        # A pair that differs in two bits of a segment may need one bit set and one cleared: walk whole balls.
        raise ValueError("radii above 1 need more segments")
    entries = _balls(classes, plan)
    own = entries.filter("own")
    heavy = own.groupBy("seg", "key").agg(F.count("*").alias("n_")).filter(F.col("n_") > bucket).select("seg", "key")
    heavy = materialize(heavy, "heavy")
    table = own.join(heavy, ["seg", "key"], "left_anti").select("seg", "key", F.col("rep").alias("dst"), F.col("fp").alias("fp2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_distance
    once = (~F.col("own")) | (F.col("fp") < F.col("fp2"))
    a, b = entries.alias("a"), table.alias("b")
    same = (F.col("a.seg") == F.col("b.seg")) & (F.col("a.key") == F.col("b.key"))
    light = a.join(b, same & once & near).select(F.col("rep").alias("src"), "dst")

    keys = ["seg", "key", "lo", "hi"]
    crowd = block_pairs(entries.join(heavy, ["seg", "key"], "left_semi").select("seg", "key", "rep", "fp"), ["seg", "key"], "rep", block)
    crowd = grouped(crowd.select(*keys, "rep", "fp"), keys, _partitions(classes))

    def run(batches):
        import pyarrow as pa

        for g in runs(batches, keys):
            fp = g["fp"].astype(np.int64).view(np.uint64)
            near = np.empty((len(fp), len(fp)), dtype=bool)
            for i in range(0, len(fp), 512):
                near[i : i + 512] = np.bitwise_count(fp[i : i + 512, None] ^ fp[None, :]) <= max_distance
            root = forest(near)
            to = np.flatnonzero(root != np.arange(len(fp)))
            if len(to):
                yield pa.RecordBatch.from_arrays([pa.array(g["rep"][root[to]], type=rep_type), pa.array(g["rep"][to], type=rep_type)], ["src", "dst"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = classes.schema["rep"].dataType
    rep_type = to_arrow_type(kind)
    dense = crowd.mapInArrow(run, T.StructType([T.StructField("src", kind), T.StructField("dst", kind)]))
    return light.unionByName(dense)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def simhash_near_dedup(
    docs: DataFrame,
    ngram: int = 4,
    max_distance: int = 4,
    segments: int = 3,
    bucket: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` of every row; see the module's text for edge cases."""
    fps = materialize(fingerprints(docs, ngram, id_col, text_col), "fingerprints")
    classes = materialize(
        fps.groupBy("fp").agg(F.min(id_col).alias("rep")).filter(F.col("rep").isNotNull()), "classes"
    )
    comp = connected_components(hamming_links(classes, max_distance, segments, bucket))
    roots = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(roots, "fp", "left").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
