"""Groups of similar items: components of the pair graph, scored by their own pairs.

Groups are rows of (group, member). Exact copies enter as one representative with a count, so a
thousand copies are a thousand rows and not half a million pairs; numbers and means of pairs follow
from the counts. Only ``similar_groups`` puts a group's members into one array, for callers that
know their groups to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.functions.paths import human_size
from twinframe.operators.components import connected_components
from twinframe.operators.numbering import numbered


def group_members(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(group_id, path)`` from ``classes(path, rep)`` and ``edges(a, b)`` between representatives; no group has one member."""
    comp = connected_components(edges, "a", "b")
    rows = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(F.coalesce("component", "rep").alias("group_id"), "path")
    several = rows.groupBy("group_id").agg(F.count("*").alias("n_")).filter("n_ > 1").select("group_id")
    return rows.join(several, "group_id", "left_semi")


def group_scores(classes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(group_id, n_members, n_edges, avg_similarity)``; copies are 100 per cent similar."""
    n = classes.groupBy("rep").agg(F.count("*").alias("n"))
    a, b = n.select(F.col("rep").alias("a"), F.col("n").alias("na")), n.select(F.col("rep").alias("b"), F.col("n").alias("nb"))
    between = edges.join(a, "a").join(b, "b").select(F.col("a").alias("rep"), (F.col("na") * F.col("nb")).alias("pairs"), "similarity")
    within = n.filter("n > 1").select("rep", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.lit(100.0).alias("similarity"))
    own = members.withColumnRenamed("path", "rep")  # a representative is a member
    pairs = between.unionByName(within).join(own, "rep")
    scores = pairs.groupBy("group_id").agg(F.sum("pairs").alias("n_edges"), (F.sum(F.col("pairs") * F.col("similarity")) / F.sum("pairs")).alias("avg_similarity"))
    return members.groupBy("group_id").agg(F.count("*").alias("n_members")).join(scores, "group_id")


def similar_groups(edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``(group_id, members, n_members, n_edges, avg_similarity)``; the id is the first member's path.

    Without ``classes`` every path is its own representative.
    """
    edges = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))
    if classes is None:
        classes = edges.select(F.explode(F.array("a", "b")).alias("path")).distinct().withColumn("rep", F.col("path"))
    members = group_members(classes, edges)
    arrays = members.groupBy("group_id").agg(F.array_sort(F.collect_list("path")).alias("members"))
    return arrays.join(group_scores(classes, edges, members), "group_id").select("group_id", "members", "n_members", "n_edges", "avg_similarity")


def group_report(scores: DataFrame, files: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``(group_no, path, avg_similarity, size_text)``: groups from the highest score on, with their files' sizes.

    ``members(group_id, path)``; without it ``scores`` has them as arrays.
    """
    if members is None:
        members = scores.select("group_id", F.explode("members").alias("path"))
    order = numbered(scores.select("group_id", "avg_similarity"), "group_no", F.desc("avg_similarity"), "group_id")
    rows = members.join(order, "group_id")
    return rows.join(files.select("path", "size_bytes"), "path", "left").select("group_no", "path", "avg_similarity", human_size(F.col("size_bytes")).alias("size_text"))


def totals(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: the numbers of items and of their pairs, of groups, and of the files in groups, all of which are moved."""
    items = classes.agg(F.count("*").alias("n_items"))
    found = groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n_members"), F.lit(0)).cast("bigint").alias("n_to_move"))
    both = items.withColumn("one", F.lit(1)).join(found.withColumn("one", F.lit(1)), "one")
    return both.select("n_items", (F.col("n_items") * (F.col("n_items") - 1) / 2).cast("bigint").alias("n_pairs"), "n_groups", "n_to_move")
