"""A stored index of hashes for range queries under the Hamming distance.

Each hash is stored with its distances to a few pivots. By the triangle inequality a hash within
``radius`` of an asking one has distances to every pivot that differ by ``radius`` at most. So a query is
a range join: the distances to the first pivots are a cell, the asking hash looks up the cells around its
own, the other pivots' distances discard more, and what remains is compared. Results are exact.

Pivots are chosen when the index is made, each as far as can be from those before it, among at most
``sample`` hashes; they only decide how much is discarded. Adding writes the new hashes as another part
of the index and leaves the parts that are there; a hash that is in it already is not stored again. Two
that add at once: one gets a ``Conflict``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions.signatures import hamming
from twinframe.operators.crowds import CROWD, dealt
from twinframe.sources.shared import discard, materialize
from twinframe.sources.versions import Version, commit, current, read_table

PIVOTS = "no int, hash bigint"


def _schema(pivots: int) -> str:
    return ", ".join(["hash bigint", *(f"d{i} int" for i in range(pivots))])


def _with_distances(hashes: DataFrame, pivots: list[int]) -> DataFrame:
    return hashes.select("hash", *(hamming(F.col("hash"), F.lit(p).cast("bigint")).cast("int").alias(f"d{i}") for i, p in enumerate(pivots)))


def choose_pivots(hashes: list[int], n: int) -> list[int]:
    """Each as far as can be from those before it; fewer if there are not so many."""
    far = {h: 65 for h in sorted(set(hashes))}
    out: list[int] = []
    while far and len(out) < n:
        out.append(max(far, key=lambda h: (far[h], -h)))
        far = {h: d for h, was in far.items() if (d := min(was, ((h ^ out[-1]) & (2**64 - 1)).bit_count())) > 0}
    return out


def create(spark: SparkSession, path: str, hashes: DataFrame, pivots: int = 4, sample: int = 1000) -> Version:
    """A new index of ``hashes(hash)`` (longs; nulls are left out)."""
    distinct = materialize(hashes.select("hash").filter("hash is not null").distinct(), "index-items")
    some = [r[0] for r in distinct.orderBy(F.xxhash64("hash")).limit(sample).collect()]
    chosen = choose_pivots(some, pivots) or [0]
    tables = {"pivots": spark.createDataFrame(list(enumerate(chosen)), PIVOTS).coalesce(1), "items": _with_distances(distinct, chosen)}
    out = commit(tables, path, Version())
    discard(distinct)
    return out


def _read(spark: SparkSession, path: str) -> tuple[Version, list[int], DataFrame]:
    version = current(spark, path)
    pivots = [r["hash"] for r in read_table(spark, version, "pivots", PIVOTS).orderBy("no").collect()]
    if not pivots:
        raise FileNotFoundError(f"{path}: no index")
    return version, pivots, read_table(spark, version, "items", _schema(len(pivots)))


def add(spark: SparkSession, path: str, hashes: DataFrame) -> Version:
    """Hashes that are not in the index yet join it."""
    version, pivots, items = _read(spark, path)
    new = hashes.select("hash").filter("hash is not null").distinct().join(items.select("hash"), "hash", "left_anti")
    return commit({"items": _with_distances(new, pivots)}, path, version, {t: list(own) for t, own in version.tables.items()})


def _cells(first: int, radius: int) -> Column:
    """The cells that may hold what is near: all combinations of the first pivots' distances."""
    around = lambda i: F.sequence(F.greatest(F.col(f"d{i}") - radius, F.lit(0)), F.least(F.col(f"d{i}") + radius, F.lit(64)))
    if first == 1:
        return F.transform(around(0), lambda x: F.struct(x.alias("c0")))
    return F.flatten(F.transform(around(0), lambda x: F.transform(around(1), lambda y: F.struct(x.alias("c0"), y.alias("c1")))))


def ask(spark: SparkSession, path: str, hashes: DataFrame, radius: int, counts: dict[str, int] | None = None) -> DataFrame:
    """``(hash, seen, distance)``: for each distinct asking hash all stored ones within ``radius``.

    With ``counts`` the numbers of hashes, of stored ones and of comparisons are put there.
    """
    _, pivots, items = _read(spark, path)
    first = 1 if len(pivots) == 1 or radius > 7 else 2
    keys = [f"c{i}" for i in range(first)]
    asked = materialize(_with_distances(hashes.select("hash").filter("hash is not null").distinct(), pivots), "index-asked")
    probe = asked.select("*", F.explode(_cells(first, radius)).alias("c")).select("hash", *(F.col(f"d{i}").alias(f"a{i}") for i in range(len(pivots))), "c.*")
    table = items.select(F.col("hash").alias("seen"), *(f"d{i}" for i in range(len(pivots))), *(F.col(f"d{i}").alias(k) for i, k in enumerate(keys)))
    table, probe, keys = dealt(table, probe, keys, CROWD)
    met = probe.join(table, keys)
    for i in range(first, len(pivots)):
        met = met.filter(F.abs(F.col(f"a{i}") - F.col(f"d{i}")) <= radius)
    if counts is not None:
        counts |= {"hashes": asked.count(), "stored": items.count(), "compared": met.count()}
    distance = hamming(F.col("hash"), F.col("seen")).cast("int")
    return met.select("hash", "seen", distance.alias("distance")).filter(F.col("distance") <= radius)
