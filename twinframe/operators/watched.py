"""Matching against hashes already seen: the nearest one for every frame, whatever item it is from.

The nearest hash is searched by growing radius over a multi-index. Hashes are cut into segments; one
that is at most ``segments * (r + 1) - 1`` bits away agrees with the asking hash in some segment up to
r bits. So the hashes that agree up to 0, 1, 2 bits in a segment are looked up in turn, and only for
hashes whose nearest so far is farther than that bound; what remains after the last radius worth
its look-ups meets the whole pool in blocks. The result is the exact minimum.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions.signatures import hamming, similarity
from twinframe.operators.crowds import dealt
from twinframe.operators.kernels import nearest_in
from twinframe.params import Params
from twinframe.sources.shared import materialize

#: Look-ups of one hash in one segment beyond which the pool is compared as a whole, and hashes of one segment's value in one block.
MOST_LOOKUPS, CROWD = 800, 4096
#: Hashes of a block of either side, where the pool is compared as a whole.
BLOCK = 262_144


def _apart(a, b, words: int):
    if words == 1:
        return hamming(a, b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: hamming(x, y)), F.lit(0), lambda s, d: s + d)


def _segments(bits: int, pool: int) -> list[list[tuple[int, int, int]]]:
    """Parts of a hash, each as ``(word, shift, width)``: about as wide as makes a value of a segment as rare as a hash, and of one word.

    As ``average_hash`` has them, words have 64 bits and the last one has the rest.
    """
    wide = max(4, min(24, round(log2(max(2, pool)))))
    out = []
    for word, at in enumerate(range(0, bits, 64)):
        own = min(64, bits - at)
        n = max(1, round(own / wide))
        edges = [own * i // n for i in range(n + 1)]
        out += [(word, a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def _value(h, words: int, segment: tuple[int, int, int]) -> Column:
    word, shift, width = segment
    one = h if words == 1 else F.get(h, F.lit(word))
    return F.shiftrightunsigned(one, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("bigint")


def _by_index(asked: DataFrame, pool: DataFrame, words: int, segments, radius: int) -> DataFrame:
    """``(hash, seen)``: pairs that agree up to exactly ``radius`` bits in a segment; a pair comes once for each such segment."""
    spell = lambda h, own: F.array(*(F.struct(F.lit(i).alias("seg"), _value(F.col(h), words, s).alias("key")) for i, s in enumerate(own)))
    table = pool.select("seen", F.explode(spell("seen", segments)).alias("e")).select("seen", "e.seg", "e.key")

    def ball(i: int, s: tuple[int, int, int]) -> Column:
        masks = F.array(*(F.lit(sum(1 << x for x in c)) for c in combinations(range(s[2]), radius))).cast("array<bigint>")
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("seg"), _value(F.col("hash"), words, s).bitwiseXOR(m).alias("key")))

    balls = F.concat(*(ball(i, s) for i, s in enumerate(segments) if s[2] >= radius))
    probe = asked.select("hash", F.explode(balls).alias("e")).select("hash", "e.seg", "e.key")
    table, probe, keys = dealt(table, probe, ["seg", "key"], CROWD)
    # Each row became many, which Spark's estimate of a table's size leaves out: neither side may be broadcast.
    return probe.join(table.hint("merge"), keys).select("hash", "seen")


def _by_blocks(asked: DataFrame, pool: DataFrame, words: int, rows: int, size: int, block: int) -> DataFrame:
    """``(hash, met)``: every hash's smallest distance to each block of the pool, a pair of blocks in one task."""
    conf = asked.sparkSession.conf
    of_pool, enough = max(1, -(-size // block)), 3 * asked.sparkSession.sparkContext.defaultParallelism
    of_asked = max(1, -(-rows // block), min(-(-enough // of_pool), rows // 256))
    long = lambda c: F.array(c) if words == 1 else F.col(c)
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("long")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    a = asked.select(long("hash").alias("h"), F.lit(True).alias("asks"), own("hash", of_asked).alias("x"), every(of_pool).alias("y"))
    b = pool.select(long("seen").alias("h"), F.lit(False).alias("asks"), own("seen", of_pool).alias("y"), every(of_asked).alias("x"))
    met = a.unionByName(b).select("h", "asks", (F.col("x") * of_pool + F.col("y")).alias("pair"))
    parts = max(1, min(int(conf.get("spark.sql.shuffle.partitions")), of_asked * of_pool))
    out = met.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(nearest_in(words), "h array<bigint>, met int")
    return out.select((F.get("h", F.lit(0)) if words == 1 else F.col("h")).alias("hash"), "met")


def nearest_distance(hashes: DataFrame, pool: DataFrame, bits: int, block: int = BLOCK, counts: dict[str, int] | None = None) -> DataFrame:
    """``(hash, distance)``: each distinct hash's smallest distance to the pool, ``bits`` if the pool is empty.

    A hash is a long, or an array of longs where it has more than 64 bits. Nulls are left out on both
    sides, which are made distinct first. With ``counts`` the numbers of hashes, of hashes seen and of
    comparisons by radius are put there.
    """
    words = -(-bits // 64)
    h = materialize(hashes.select("hash").filter("hash is not null").distinct(), "hashes")
    p = materialize(pool.select(F.col("hash").alias("seen")).filter("seen is not null").distinct(), "pool")
    size = p.count()
    if counts is not None:
        counts |= {"hashes": h.count(), "pool": size}
    far = lambda df: df.select("hash", F.lit(bits).alias("distance"))
    if not size:
        return far(h)
    same = h.join(p.hint("merge"), F.col("hash") == F.col("seen"), "left_semi").withColumn("distance", F.lit(0))
    nearest = lambda met: met.groupBy("hash").agg(F.min(_apart(F.col("hash"), F.col("seen"), words)).alias("met"), F.count("*").alias("n"))
    found, left = [same], materialize(far(h.join(p.hint("merge"), F.col("hash") == F.col("seen"), "left_anti")), "asking")
    segments = _segments(bits, size)
    for radius in range(bits):
        lookups = sum(comb(w, radius) for *_, w in segments)
        # What a round may settle has to be worth more than what it looks up: one look-up is dear against one comparison of blocks.
        if left.isEmpty() or lookups > min(MOST_LOOKUPS, size):
            break
        best = nearest(_by_index(left.select("hash"), p, words, segments, radius))
        now = materialize(left.join(best, "hash", "left").select("hash", F.least("distance", F.coalesce("met", "distance")).alias("distance"), "n"), "asking")
        if counts is not None:
            counts[f"radius {radius}"] = now.agg(F.sum("n")).first()[0] or 0
        settled = F.col("distance") <= len(segments) * (radius + 1)  # what has not been met is farther than one bit less
        found.append(now.filter(settled).select("hash", "distance"))
        left = now.filter(~settled).select("hash", "distance")
    if counts is not None:
        counts["blocks"] = left.count() * size
    rest = _by_blocks(left.select("hash"), p, words, left.count(), size, block)
    out = rest.groupBy("hash").agg(F.min("met").alias("distance"))
    for df in found:
        out = out.unionByName(df)
    return out.select("hash", F.least("distance", F.lit(bits)).alias("distance"))


def split_watched(signatures: DataFrame, pool: DataFrame, params: Params) -> DataFrame:
    """``(path, similarity, is_watched)`` of every item with hashes; those without are in neither part.

    ``pool`` has a column ``hash``: a frame's hash, all of its words together (see ``sources.watched.pool``).
    """
    words = params.words
    begins = F.sequence(F.lit(1), F.size("hashes"), F.lit(words))
    whole = F.col("hashes") if words == 1 else F.transform(begins, lambda i: F.slice("hashes", i, words))
    frames = signatures.filter(F.size("hashes") > 0).select("path", F.explode(whole).alias("hash"))
    near = nearest_distance(frames, pool, params.bits)
    per = frames.join(near.hint("merge"), "hash").groupBy("path").agg(F.sum("distance").alias("total"), F.count("*").alias("n"))
    score = similarity(F.col("total"), F.col("n"), params.bits)
    return per.select("path", score.alias("similarity"), (score >= params.threshold).alias("is_watched"))
