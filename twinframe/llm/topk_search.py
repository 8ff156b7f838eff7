"""Exact top-k inner-product search, score at a time over an impact-ordered index (operator 7).

Vectors are dealt into shards of bounded size. A shard's index holds, for each dimension, its
vectors in order of that dimension's integer, cut into segments of equal quantised impact. For a
query, the impact of a segment is the most that its members can gain in that dimension over the
worst vector of the shard. Segments of all dimensions are processed by descending impact, adding
their postings to accumulators. At any time a vector's score lies between its accumulator and that
plus, for every dimension, the impact of the dimension's next segment; a shard stops only when the
vectors that may still reach the k-th best accumulator are few, or all segments are done. Those
vectors, and no others, are scored again exactly.

Queries go to every shard in blocks: rows of the query set times shards, never vectors times
vectors. A shard gives at most k rows a query; the k best of all shards are taken with a partial
limit before the shuffle.

Edge cases. Vectors that are null, empty or hold a null or non-finite component are neither queries
nor candidates. Rows that repeat an id are all candidates, but not of a query with that id; all are
queries if one is, and share its k places. A shorter vector counts as padded with zeros. A null id
takes no part. Equal scores go to the smaller
id; a query with fewer candidates than k gets all. Scores are exact while the sum of products fits
a signed 64-bit integer. Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ImpactIndex:
    """Postings of integer vectors by dimension and quantised impact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = 16):
        self.ids, self.x, self.levels = ids, x, levels
        n, d = x.shape
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32).copy()
        self.values = np.take_along_axis(x, self.order.T.astype(np.int64), axis=0).T.copy()
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        step = (self.high - self.low) // levels + 1
        level = (self.values - self.low[:, None]) // step[:, None]
        #: begin[j, l] is where level l of dimension j begins; lowest and highest number of each level's segment.
        self.begin = np.stack([np.searchsorted(level[j], np.arange(levels + 1)) for j in range(d)])

    def search(self, q: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, by score and then id, without rows of the id ``skip``; the index's ids are in order."""
        n, d = self.x.shape
        own = slice(*(int(np.searchsorted(self.ids, skip, side)) for side in ("left", "right"))) if skip is not None else slice(0, 0)
        k = min(k, n - (own.stop - own.start))
        if k <= 0:
            return self.ids[:0], self.ids[:0]
        few = max(4 * k, n // 64)
        acc = np.zeros(n, dtype=np.int64)
        up, size = q > 0, np.abs(q)
        worst = np.where(up, self.low, self.high)
        # Impact of each segment: the best number in it against the dimension's worst.
        last = np.maximum(self.begin[:, 1:] - 1, 0)
        first = np.minimum(self.begin[:, :-1], n - 1)
        best = np.where(up[:, None], np.take_along_axis(self.values, last, 1), np.take_along_axis(self.values, first, 1))
        impact = size[:, None] * np.abs(best - worst[:, None])
        impact[self.begin[:, 1:] == self.begin[:, :-1]] = 0
        top = int(impact.max())
        if top == 0:
            maybe = np.arange(n)
        else:
            done = np.zeros(d, dtype=np.int64)  # segments processed, from the dimension's good end
            towards = np.where(up[:, None], impact[:, ::-1], impact)  # in processing order
            towards = np.maximum.accumulate(towards[:, ::-1], axis=1)[:, ::-1]
            maybe, floor = None, top
            while maybe is None:
                floor = floor * 2 // 5 if floor > top // 50 else 0
                todo = (towards > floor).sum(axis=1) if floor else np.where(towards[:, 0] > 0, self.levels, 0)
                for j in np.flatnonzero(todo > done):
                    a, b = done[j], todo[j]
                    lo, hi = (self.begin[j, self.levels - b], self.begin[j, self.levels - a]) if up[j] else (self.begin[j, a], self.begin[j, b])
                    acc[self.order[j, lo:hi]] += size[j] * np.abs(self.values[j, lo:hi] - worst[j])
                done = np.maximum(done, todo)
                rest = int(np.where(done < self.levels, towards[np.arange(d), np.minimum(done, self.levels - 1)], 0).sum())
                acc[own] = -1 - rest
                kth = np.partition(acc, n - k)[n - k]
                able = np.flatnonzero(acc + rest >= kth)
                if len(able) <= few or not rest:
                    maybe = able
                else:
                    acc[own] = 0
        maybe = maybe[(maybe < own.start) | (maybe >= own.stop)]
        score = self.x[maybe] @ q
        pick = np.lexsort((self.ids[maybe], -score))[:k]
        return self.ids[maybe][pick], score[pick]


def integer_vectors(df: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """``(id, row, x)``: floor(scale * component) of every usable vector, under a number for its row."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    used = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    ints = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return used.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), ints.alias("x"))


def top_k(
    df: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, shard: int = 8192, block: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: rows whose id is divisible by ``every`` against all other rows."""
    from twinframe.sources.shared import materialize

    vectors = materialize(integer_vectors(df, scale, id_col, vec_col), "vectors")
    n = vectors.count()
    asked = vectors.filter(F.col("id") % every == 0)
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked.count() // block))
    h = F.xxhash64("row")
    mine = vectors.select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "id", "x")
    theirs = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(h, F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "id", "x")
    parts = max(shards * blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = mine.unionByName(theirs).repartition(parts, "shard", "block").sortWithinPartitions("shard", "block", "kind", "id")

    def run(batches):
        import pyarrow as pa

        held: dict = {"at": None, "ids": [], "x": [], "index": None}

        def matrix(rows, d):
            out = np.zeros((len(rows), d), dtype=np.int64)
            for i, r in enumerate(rows):
                out[i, : len(r)] = r[:d]
            return out

        for b in batches:
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "block", "kind", "id")}
            xs = b.column("x")
            out: tuple[list, list, list, list] = ([], [], [], [])
            offsets, flat = xs.offsets.to_numpy(), xs.values.to_numpy(zero_copy_only=False)
            for i in range(b.num_rows):
                at = (cols["shard"][i], cols["block"][i])
                if at != held["at"]:
                    held = {"at": at, "ids": [], "x": [], "index": None}
                x = flat[offsets[i] : offsets[i + 1]]
                if cols["kind"][i] == 0:
                    held["ids"].append(cols["id"][i])
                    held["x"].append(x.copy())
                    continue
                if not held["ids"]:
                    continue
                if held["index"] is None:
                    held["index"] = ImpactIndex(np.array(held["ids"]), matrix(held["x"], max(map(len, held["x"]))))
                    held["x"] = []
                q = matrix([x], held["index"].x.shape[1])[0]
                ids, scores = held["index"].search(q, k, cols["id"][i])
                out[0].append(np.full(len(ids), cols["id"][i])), out[1].append(ids), out[2].append(scores)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out[:3]], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
