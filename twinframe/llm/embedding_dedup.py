"""Embedding near-duplicates by cross-polytope hashing (operator 9).

Vectors of equal numbers collapse to one row with a count first. Each remaining vector goes through
``tables`` x ``width`` pseudo-random rotations, each three rounds of random signs and a fast
Hadamard transform; the hash of a rotation is the axis, with its sign, that the vector is closest
to, and a bucket is ``width`` hashes of a table. Besides its own bucket a vector also enters the
``probes - 1`` next-closest ones of each table, by the sum of the squared distances that the other
axes lie further off; two vectors meet when any of their buckets agree. What meets is verified by
its cosine in double precision.

Buckets with a single entry go before any vector is shipped. Large ones are compared in pairs of
blocks (see blocks.py) and give a spanning forest rather than pairs. Links are counted afterwards
within the components, all of them and again in blocks, so a vector's count does not depend on
which buckets a link was seen in.

Edge cases. Null, empty and all-zero vectors, and those with null or non-finite components, link
with nothing and are their own component. Vectors of different lengths never link. Rows that repeat
an id count as vectors of their own; they share the id's smallest component and largest count. A
row with a null id takes part in nothing: its links are 0 and its component null. Extra columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.blocks import block_pairs, forest, grouped, runs
from twinframe.operators.components import connected_components
from twinframe.sources.shared import materialize


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows times random signs and a Hadamard transform, once for each row of ``signs``."""
    y = x
    for s in signs:
        y = y * s
        n, h = y.shape[1], 1
        while h < n:
            z = y.reshape(len(y), n // (2 * h), 2, h)
            y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), axis=2).reshape(len(y), n)
            h *= 2
        y = y / np.sqrt(n)
    return y


def buckets(x: np.ndarray, tables: int, width: int, probes: int, near: int = 3, seed: int = 7) -> np.ndarray:
    """Bucket codes (rows x tables x probes) of unit vectors; the first probe is the vector's own bucket."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length()
    padded = np.zeros((n, size))
    padded[:, :d] = x
    signs = np.random.RandomState(seed + size).choice((-1.0, 1.0), (tables, width, 3, size))
    near = min(near, 2 * size)
    probes = min(probes, near**width)
    combos = np.array(list(product(range(near), repeat=width)))
    out = np.empty((n, tables, probes), dtype=np.int64)
    for t in range(tables):
        codes, losses = [], []
        for k in range(width):
            y = rotate(padded, signs[t, k])
            both = np.concatenate((y, -y), axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(both, top, axis=1)
            codes.append(top)
            losses.append((value[:, :1] - value) ** 2)
        loss = sum(losses[k][:, combos[:, k]] for k in range(width))
        code = sum(codes[k][:, combos[:, k]].astype(np.int64) * (2 * size) ** k for k in range(width))
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(code, best, axis=1)
    return out


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(rep, n, dim, unit)``: one row per distinct usable vector: smallest id, copies, length, and the unit vector as doubles."""
    v = F.col("v_")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    src = df.select(F.col(id_col).alias("id_"), F.col(vec_col).cast("array<double>").alias("v_"))
    used = src.filter(F.col("id_").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    keyed = used.withColumns(_key(v))
    one = keyed.groupBy("k1_", "k2_").agg(F.min("id_").alias("rep"), F.count("*").alias("n"), F.first("v_").alias("v_"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            unit, dim = [], []
            for x in b.column("v_").to_pylist():
                x = np.array(x)
                x = x / np.abs(x).max()
                unit.append((x / np.sqrt(x @ x)).tobytes())
                dim.append(len(x))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "n", "k1_", "k2_")), pa.array(dim, type=pa.int32()), pa.array(unit, type=pa.binary())], schema.names)

    kind = src.schema["id_"].dataType
    schema = T.StructType().add("rep", kind).add("n", "long").add("k1_", "long").add("k2_", "long").add("dim", "integer").add("unit", "binary")
    return one.mapInArrow(run, schema)


def _key(v) -> dict:
    """128 bits of hash stand for the numbers of a vector."""
    return {"k1_": F.xxhash64(v), "k2_": F.xxhash64(F.lit(1), v)}


def _matrix(unit: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(unit), dtype=np.float64).reshape(len(unit), -1)


def embedding_near_dedup(
    df: DataFrame,
    threshold: float = 0.95,
    tables: int = 3,
    width: int = 3,
    probes: int = 8,
    block: int = 1024,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` of every row; see the module's text for edge cases."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reps = materialize(unit_vectors(df, id_col, vec_col), "units")
    kind = reps.schema["rep"].dataType

    def hashes(batches):
        import pyarrow as pa

        for b in batches:
            dims, units, rep = b.column("dim").to_numpy(), np.array(b.column("unit").to_pylist(), dtype=object), b.column("rep")
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                code = buckets(_matrix(units[at]), tables, width, probes)
                n, t, p = code.shape
                yield pa.RecordBatch.from_arrays(
                    [rep.take(pa.array(np.repeat(at, t * p))), pa.array(np.full(n * t * p, d, dtype=np.int32)), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)), pa.array(code.reshape(-1))],
                    ["rep", "dim", "table", "bucket"],
                )

    entry = T.StructType().add("rep", kind).add("dim", "integer").add("table", "integer").add("bucket", "long")
    entries = reps.repartition(parts, "rep").select("rep", "dim", "unit").mapInArrow(hashes, entry)
    keys = ["dim", "table", "bucket", "lo", "hi"]
    met = block_pairs(materialize(entries, "buckets"), keys[:3], "rep", block).join(reps.select("rep", "unit"), "rep")

    def link(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        t, src, dst = to_arrow_type(kind), [], []
        for g in runs(batches, keys):
            x = _matrix(g["unit"])
            root = forest(x @ x.T >= threshold)
            to = np.flatnonzero(root != np.arange(len(x)))
            if len(to):
                src.append(g["rep"][root[to]]), dst.append(g["rep"][to])
            if sum(map(len, src)) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src), type=t), pa.array(np.concatenate(dst), type=t)], ["src", "dst"])
                src, dst = [], []
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src), type=t), pa.array(np.concatenate(dst), type=t)], ["src", "dst"])

    edges = grouped(met.select(*keys, "rep", "unit"), keys, parts).mapInArrow(link, T.StructType().add("src", kind).add("dst", kind))
    comp = materialize(connected_components(edges).withColumnRenamed("node", "rep"), "components")

    keys2 = ["component", "lo", "hi"]
    inside = block_pairs(reps.select("rep", "n", "unit").join(comp, "rep"), ["component"], "rep", block)

    def count(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        reps_, links = [], []
        for g in runs(batches, keys2):
            x, n, own = _matrix(g["unit"]), g["n"].astype(np.int64), g["own"]
            here = np.empty(len(x), dtype=np.int64)
            cross = g["lo"][0] != g["hi"][0]
            for i in range(0, len(x), 512):
                near = x[i : i + 512] @ x.T >= threshold
                near[np.arange(len(near)), i + np.arange(len(near))] = False
                if cross:
                    near &= own[i : i + 512, None] != own[None, :]
                here[i : i + 512] = near @ n
            reps_.append(g["rep"]), links.append(here)
            if sum(map(len, links)) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps_), type=to_arrow_type(kind)), pa.array(np.concatenate(links))], ["rep", "links"])
                reps_, links = [], []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps_), type=to_arrow_type(kind)), pa.array(np.concatenate(links))], ["rep", "links"])

    counted = grouped(inside.select(*keys2, "own", "rep", "n", "unit"), keys2, parts).mapInArrow(count, T.StructType().add("rep", kind).add("links", "long"))
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = (
        reps.select("rep", "n", "k1_", "k2_").join(comp, "rep", "left").join(links, "rep", "left")
        .select("k1_", "k2_", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id_"), *(c.alias(k) for k, c in _key(v).items()))
    rows = rows.join(of_class, ["k1_", "k2_"], "left")
    lone = F.col("id_").isNull()
    return rows.select(
        F.col("id_").alias(id_col),
        F.when(lone, 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(~lone, F.coalesce("component", "id_")).alias("component_id"),
        F.coalesce(F.col("id_") == F.coalesce("component", "id_"), F.lit(False)).alias("kept"),
    )
