"""Connected components of an edge table by alternating star contractions.

Each round is two aggregations and two equi-joins on node ids (large-star, then small-star, after
Kiveris et al. 2014), so the number of rounds grows with the logarithm of the longest path rather
than with its length. Neighbours are never collected into lists: the minimum is a partially
aggregated MIN and is joined back, so a node with very many edges is only a skewed join key, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.sources.shared import discard, materialize


def _state(edges: DataFrame) -> tuple:
    """Size and order-free digest of an edge set."""
    h = F.xxhash64("u", "v")
    row = edges.agg(
        F.count("*"), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))), F.bit_xor(h)
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    A contraction has no more edges than the one before it, so the written tables need no more tasks
    than the number of edges asks for.

    Edges are undirected; self-loops, repeated edges and edges with a null end are ignored (a node
    that has no other edge is not in the result). Node ids may be of any orderable type. An empty
    edge table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    cur = materialize(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    seen = _state(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = materialize(large, "large", 2 * seen[0])
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(root, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        nxt = materialize(small, "small", 2 * seen[0])
        discard(large)
        discard(cur)
        cur, before, seen = nxt, seen, _state(nxt)
        if seen == before:
            break
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def add_edges(components: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` after new edges, from what they were before.

    Ends are replaced by the components they are in, so only new edges between components are contracted, and
    the nodes of components that meet get the smallest of their labels. Nodes that are new join.
    """
    label = components.select(F.col("node").alias("end_"), F.col("component").alias("label_"))
    known = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    for end in (src, dst):
        known = known.join(label.withColumnRenamed("end_", end), end, "left").withColumn(f"{end}_", F.coalesce("label_", end)).drop("label_")
    met = connected_components(known.select(F.col(f"{src}_").alias("src"), F.col(f"{dst}_").alias("dst")))
    moved = met.select(F.col("node").alias("component"), F.col("component").alias("to_"))
    old = components.join(moved, "component", "left").select("node", F.coalesce("to_", "component").alias("component"))
    return old.unionByName(met.join(components, "node", "left_anti"))
