"""Pairs of similar signatures: an exact Hamming similarity self-join.

All strategies give the pairs whose summed distance is at most the widest similar one.

``blocks`` compares all pairs: rows are dealt into blocks, and each pair of blocks is one group of a
task, so nothing is broadcast, no side has to fit in memory, and only signatures, their paths and the pairs
found travel. ``operators.kernels`` compares a group's rows in tiles.

``bands`` finds candidates first and verifies them after. Where few bits may differ, signatures are cut
into bands of 16 bits, each with a radius r: pairs that agree in a band up to r bits have a match of weight
r + 1. The bands in which a similar pair has no match cost it r + 1 bits each, so its matches weigh at least
the sum of all r + 1 less the widest distance. One side lists its bands' values, the other looks up those;
what travels is numbers of rows, values and weights. Pairs with enough weight are joined with
their signatures and compared. A value that more than ``crowd`` signatures share is dealt into blocks,
every pair of which is a key, so no key has more rows of either side. ``slack`` widens the radii beyond
what one match needs: more look-ups, and fewer pairs to verify.

Where neighbours of a value have to be looked up as well, or values are so common that more than MATCHES rows
a signature would meet, none of that is shuffled: each pair of blocks has an index of its bands in its task
(at 128 of 1280 bits: 65 bands, 1365 look-ups), and candidates are compared where they are found.
``auto`` takes bands where they can be shuffled and their look-ups are fewer than a hundredth of all pairs,
else blocks. At such wide distances both are quadratic in the end, in time only.
Equal signatures are joined once: copies are classes.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions.signatures import similarity, total_distance, widest
from twinframe.operators.crowds import CROWD, dealt
from twinframe.operators.kernels import Close, dealt_pairs
from twinframe.params import Params
from twinframe.sources.shared import materialize

BAND = 16
#: Rows of a block at most, in one task; and pairs a signature that may meet in a shuffle of bands.
BLOCK, MATCHES = 131_072, 200


def _wide(signatures: DataFrame, n: int) -> DataFrame:
    return signatures.select("path", *(F.col("hashes")[i].alias(f"h{i}") for i in range(n)))


def _distance(n: int):
    return total_distance([F.col(f"a.h{i}") for i in range(n)], [F.col(f"b.h{i}") for i in range(n)], n)


def _close(n: int, most: int):
    """Distance at most ``most``, with a first look at a quarter of the words."""
    some = max(1, n // 4)
    first = total_distance([F.col(f"a.h{i}") for i in range(some)], [F.col(f"b.h{i}") for i in range(some)], some)
    return (first <= most) & (_distance(n) <= most)


def _blocks(spark: SparkSession, rows: int, block: int) -> int:
    """Blocks of at most ``block`` rows, and enough pairs of blocks for all cores while they have 256 rows."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, -(-rows // block), min(ceil(sqrt(6 * cores)), rows // 256))


def _numbered(wide: DataFrame) -> DataFrame:
    return materialize(wide.withColumn("id", F.monotonically_increasing_id()), "numbered-signatures")


def _in_blocks(wide: DataFrame, n: int, most: int, block: int, word_bits: int, indexed: bool) -> DataFrame:
    """``(a, b, total)`` of the close pairs of ``wide(path, h0, h1, ...)``, copies too; each pair of blocks is in one task, which knows the paths."""
    spark = wide.sparkSession
    blocks = _blocks(spark, wide.count(), block)
    own = F.pmod(F.xxhash64("path"), F.lit(blocks)).cast("int")
    met = wide.select("path", F.array(*(f"h{i}" for i in range(n))).alias("h"), own.alias("own")).withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    lo, hi = F.least("own", "met"), F.greatest("own", "met")
    # Tasks have as many pairs of blocks each, give or take one.
    pairs = blocks * (blocks + 1) // 2
    parts = min(pairs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism))
    place = (lo * blocks - F.expr("least(own, met) * (least(own, met) - 1) div 2") + hi - lo) % parts
    met = met.select("path", "h", "own", (lo * blocks + hi).alias("pair"), place.cast("int").alias("place"))
    dealt = met.repartitionById(parts, "place").drop("place").sortWithinPartitions("pair")
    found = dealt.mapInArrow(dealt_pairs(Close(n, most, word_bits, indexed), blocks), "a string, b string, total int").filter("a != b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total")


def _by_blocks(wide: DataFrame, n: int, most: int, block: int, word_bits: int = 64) -> DataFrame:
    return _in_blocks(wide, n, most, block, word_bits, False)


def pairs_between(new: DataFrame, old: DataFrame, params: Params, block: int = 4096) -> DataFrame:
    """``(a, b, similarity)``, a from ``new`` and b from ``old`` (path, hashes): all similar pairs, by blocks."""
    n, most = params.num_frames * params.words, widest(params.threshold, params.num_frames, params.bits)
    sides = [_wide(x.filter(F.size("hashes") == n), n) for x in (new, old)]
    of_new, of_old = (_blocks(x.sparkSession, x.count(), block) for x in sides)
    own = lambda k: F.pmod(F.xxhash64("path"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = sides[0].withColumn("x", own(of_new)).withColumn("y", every(of_old)).alias("a")
    b = sides[1].withColumn("y", own(of_old)).withColumn("x", every(of_new)).hint("shuffle_hash").alias("b")
    met = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & _close(n, most))
    return met.select(F.col("a.path").alias("a"), F.col("b.path").alias("b"), similarity(_distance(n), F.lit(params.num_frames), params.bits).alias("similarity"))


def band_radii(most: int, bands: int, slack: int = 0) -> list[int]:
    """A radius for each band, -1 where it is not used, so that the sum of all r + 1 is ``most`` + 1 + ``slack``, if radii up to 1 allow it."""
    share, more = divmod(most + 1, bands)
    if share + (more > 0) > 2:
        raise ValueError("too wide a distance for bands; use blocks")
    share, more = divmod(min(2 * bands, most + 1 + slack), bands)
    return [share - 1 + (i < more) for i in range(bands)]


def candidates(rows: DataFrame, n: int, most: int, word_bits: int, slack: int = 0, crowd: int = 4096) -> DataFrame:
    """``(a, b)``, ids of ``rows(id, h0, h1, ...)`` with a < b: all similar pairs, and others whose bands match as well."""
    each = -(-word_bits // BAND)
    radii = band_radii(most, n * each, slack)
    used = [(i, r) for i, r in enumerate(radii) if r >= 0]
    if not used:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    entry = lambda i, r: F.struct(F.lit(i).cast("short").alias("band"), _value(i, each).alias("key"), F.lit(r + 1).alias("weight"))
    table = rows.select("id", F.explode(F.array(*(entry(*x) for x in used))).alias("e")).select("id", "e.band", "e.key", "e.weight")
    flips = F.array(F.lit(0), *(F.lit(1 << x) for x in range(min(BAND, word_bits))))
    probe = table.withColumn("mask", F.explode(F.when(F.col("weight") == 2, flips).otherwise(F.array(F.lit(0)))))
    probe = probe.select("id", "band", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), "weight")
    table, probe, keys = dealt(table.select("id", "band", "key"), probe, ["band", "key"], crowd)
    met = table.select(F.col("id").alias("a"), *keys).join(probe.withColumnRenamed("id", "b").hint("merge"), keys).filter("a < b")
    enough = sum(r + 1 for _, r in used) - most
    return met.groupBy("a", "b").agg(F.sum("weight").alias("weight")).filter(F.col("weight") >= enough).select("a", "b")


def _value(i: int, each: int):
    """The value of band ``i``, of ``each`` bands a word."""
    return F.shiftrightunsigned(f"h{i // each}", BAND * (i % each)).bitwiseAND(F.lit((1 << BAND) - 1)).cast("int")


def _few_matches(rows: DataFrame, n: int, most: int, word_bits: int, slack: int) -> bool:
    """Whether bands look up no neighbours, and no more than MATCHES pairs a signature agree in one."""
    each = -(-word_bits // BAND)
    try:
        radii = band_radii(most, n * each, slack)
    except ValueError:
        return False
    if max(radii) > 0:
        return False
    used = [F.struct(F.lit(i).alias("band"), _value(i, each).alias("key")) for i, r in enumerate(radii) if r >= 0]
    if not used:
        return True
    same = rows.select(F.explode(F.array(*used)).alias("e")).groupBy("e.band", "e.key").agg(F.count("*").cast("double").alias("n"))
    met = same.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    return met <= MATCHES * rows.count()


def _by_bands(wide: DataFrame, n: int, most: int, word_bits: int, slack: int, crowd: int, block: int = BLOCK) -> DataFrame:
    if not _few_matches(wide, n, most, word_bits, slack):
        return _in_blocks(wide, n, most, block, word_bits, True)
    rows = _numbered(wide)
    ids = candidates(rows, n, most, word_bits, slack, crowd).withColumnsRenamed({"a": "ia", "b": "ib"})
    found = ids.join(rows.alias("a"), F.col("ia") == F.col("a.id")).join(rows.alias("b"), F.col("ib") == F.col("b.id")).filter(_close(n, most))
    return found.select(F.least("a.path", "b.path").alias("a"), F.greatest("a.path", "b.path").alias("b"), _distance(n).alias("total"))


def _lookups(most: int, bands: int, word_bits: int, slack: int) -> int | None:
    """Values that a signature looks up; None if bands cannot do it."""
    try:
        return sum((1, 1 + min(BAND, word_bits))[r] for r in band_radii(most, bands, slack) if r >= 0)
    except ValueError:
        return None


def _whole(signatures: DataFrame, n: int) -> DataFrame:
    return signatures.filter((F.size("hashes") == n) & F.forall("hashes", lambda h: h.isNotNull())).select("path", "hashes")


def _limits(params: Params) -> tuple[int, int, int]:
    """Words of a signature, the largest distance that is similar, and bits of a word."""
    return params.num_frames * params.words, widest(params.threshold, params.num_frames, params.bits), min(64, params.bits)


def _chosen(wide: DataFrame, n: int, most: int, word_bits: int, slack: int) -> str:
    """What ``auto`` takes for distinct signatures."""
    lookups = _lookups(most, n * -(-word_bits // BAND), word_bits, slack)
    many = lookups is not None and 200 * lookups < wide.count()
    return "bands" if many and _few_matches(wide, n, most, word_bits, slack) else "blocks"


def similar_classes(signatures: DataFrame, params: Params, strategy: str = "auto", block: int | None = None, slack: int = 0) -> tuple[DataFrame, DataFrame]:
    """``classes(path, rep)``: the first path of those with equal signatures stands for all; and ``pairs(a, b, similarity)`` of representatives.

    Signatures of the wrong length or with nulls are left out.
    """
    n, most, word_bits = _limits(params)
    whole = _whole(signatures, n)
    reps = whole.groupBy("hashes").agg(F.min("path").alias("rep"))
    classes = whole.join(reps, "hashes").select("path", "rep")
    wide = _wide(reps.withColumnRenamed("rep", "path"), n)
    if strategy == "auto":
        strategy = _chosen(wide, n, most, word_bits, slack)
    if strategy == "bands":
        found = _by_bands(wide, n, most, word_bits, slack, block or CROWD, block or BLOCK)
    else:
        found = _by_blocks(wide, n, most, block or BLOCK, word_bits)
    return classes, found.select("a", "b", similarity(F.col("total"), F.lit(params.num_frames), params.bits).alias("similarity"))


def similar_pairs(signatures: DataFrame, params: Params, strategy: str = "auto", block: int | None = None, slack: int = 0) -> DataFrame:
    """``(a, b, similarity)`` with a < b of ``signatures(path, hashes)``, copies as pairs like any other.

    The result is as large as the number of pairs, so tasks that compare signatures give the paths themselves and
    nothing is joined to it; groups are made from ``similar_classes`` instead.
    """
    n, most, word_bits = _limits(params)
    whole = _whole(signatures, n)
    distinct = _wide(whole.dropDuplicates(["hashes"]), n)
    if strategy == "auto":
        strategy = _chosen(distinct, n, most, word_bits, slack)
    if strategy == "blocks" or not _few_matches(distinct, n, most, word_bits, slack):
        rows = _wide(whole.filter("path is not null"), n)
        found = _by_blocks(rows, n, most, block or BLOCK, word_bits) if strategy == "blocks" else _in_blocks(rows, n, most, block or BLOCK, word_bits, True)
        return found.select("a", "b", similarity(F.col("total"), F.lit(params.num_frames), params.bits).alias("similarity"))
    classes, found = similar_classes(signatures, params, "bands", block, slack)
    left, right = classes.select(F.col("rep").alias("a"), F.col("path").alias("x")), classes.select(F.col("rep").alias("b"), F.col("path").alias("y"))
    between = found.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    if most < 0:
        return between
    within = left.join(right, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(100.0).alias("similarity"))
    return between.unionByName(within)
