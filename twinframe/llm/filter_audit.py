"""How quality filters interact, whatever the order they are applied in (operator 12).

Every row fails some set of the filters, a bit mask. Which rows a filter takes away in any order
follows from the number of rows with each mask, so one pass counts masks and all orders are read
from the counts. Four filters look at one text; the fifth fails texts that a smaller id has too.

Copies are found by fingerprint routing. Within a task, a table of chains holds each text once, with
the smallest id seen and the rows that have it; rows with larger ids fail at once and are not sent.
What is left goes to the partition of its text's xxHash, sorted by it, where again a chain keeps the
full texts that share a fingerprint, each with its smallest id, and other ids are emitted as copies.
So texts are compared themselves, a text that a third of all rows share is sent once a table, and
a task holds one fingerprint's chain. Labels join the slim rows, equal ones as one, and
``combineByKey`` merges vectors of counts by part.

Edge cases. A null text is an empty one. A row without an id is a copy of nothing and makes nothing a
copy; rows that repeat the smallest id are none either. A row is good or toxic if any label of its id
is 1; null labels and labels without an id say nothing. A null part is the empty string. Extra columns
are ignored. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Upper-case letters, and the characters that filter D looks for.
_UPPER, _ODD = bytes(range(65, 91)), b"#$%&*|"
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def failed(text: bytes, points: int) -> int:
    """The filters A to D that a text of so many code points fails, as bits."""
    words = text.split()
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, _UPPER))) > 2 * points) << 2
        | (len(text.translate(None, _ODD)) < len(text)) << 3
    )


class Chains:
    """Texts by fingerprint, each with its smallest id and the number of rows that have it by (part, mask)."""

    def __init__(self):
        self.by: dict[int, dict[bytes, tuple]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, id_, rows: dict) -> Iterator[tuple]:
        """Takes in rows of one text and id; yields the slim rows that are copies of a smaller id."""
        chain = self.by.setdefault(key, {})
        if (known := chain.get(text)) is None:
            chain[text] = (id_, dict(rows))
            self.bytes += len(text) + 200
        elif known[0] == id_:
            for k, n in rows.items():
                known[1][k] = known[1].get(k, 0) + n
        else:
            lost, lost_rows = (id_, rows) if known[0] < id_ else known
            if lost_rows is not rows:
                chain[text] = (id_, dict(rows))
            yield from slim(lost, lost_rows, COPY)

    def items(self) -> Iterator[tuple]:
        return ((key, (text, id_, rows)) for key, chain in self.by.items() for text, (id_, rows) in chain.items())


def slim(id_, rows: dict, bits: int = 0) -> Iterator[tuple]:
    """``(id, part, mask, n)`` of rows by (part, mask)."""
    return ((id_, part, mask | bits, n) for (part, mask), n in rows.items())


def _local(rows, most: int = 16 << 20) -> Iterator[tuple]:
    """A task's rows: ``(key, (text, id, rows))`` of texts with the smallest id so far, and ``(key, slim row)`` of what is settled."""
    chains, settled = Chains(), 0
    for id_, text, part in rows:
        text = text or ""
        raw = text.encode()
        key, row = xxh64_intdigest(raw), {(part or "", failed(raw, len(text))): 1}
        for x in slim(None, row) if id_ is None else chains.add(key, raw, id_, row):
            settled += 1
            yield settled, x
        if chains.bytes > most:
            yield from chains.items()
            chains = Chains()
    yield from chains.items()


def _routed(rows) -> Iterator[tuple]:
    """A partition's rows, sorted by key: all slim rows, one fingerprint's chain at a time."""
    chains, at = Chains(), None
    for key, x in rows:
        if len(x) == 4:
            yield x
            continue
        if key != at:
            for _, (_, id_, own) in chains.items():
                yield from slim(id_, own)
            chains, at = Chains(), key
        text, id_, own = x
        yield from chains.add(key, text, id_, own)
    for _, (_, id_, own) in chains.items():
        yield from slim(id_, own)


def _partitions(docs: DataFrame, text_col: str, each: int = 64 << 20) -> int:
    """As many partitions as shuffles have, more where one would hold above ``each`` bytes of text."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", partitions: int | None = None) -> DataFrame:
    """``(id, part, mask, n)``: the rows of ``docs`` by id, part and the set of filters that they fail."""
    n = partitions or _partitions(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col, F.col(part_col).cast("string")).rdd.mapPartitions(_local).repartitionAndSortWithinPartitions(n, lambda key: key).mapPartitions(_routed)
    return docs.sparkSession.createDataFrame(found, f"id {kind}, part string, mask int, n bigint", verifySchema=False)


def tables() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All orders and steps, and for each figure the masks that count for each of them."""
    steps, rows = [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
    mask = np.arange(MASKS)
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            steps.append((order, step))
            fails, left = mask & own != 0, mask & before == 0
            for k, x in (("kept", left & ~fails), ("removed", left & fails), ("redundant", ~left & fails), ("unique_fails", mask == own)):
                rows[k].append(x)
            before |= own
    return steps, {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of one part; ``counts`` has all, good and toxic rows by mask."""
    steps, of = tables()
    every, good, toxic = counts.reshape(3, MASKS)
    kept, removed, redundant, unique = (of[k] @ every for k in ("kept", "removed", "redundant", "unique_fails"))
    good_lost, toxic_lost = of["removed"] @ good, of["removed"] @ toxic
    shapley: dict[str, int] = {}
    for (order, step), n in zip(steps, removed.tolist(), strict=True):
        shapley[order[step - 1]] = shapley.get(order[step - 1], 0) + n
    for i, (order, step) in enumerate(steps):
        yield (part, order, step, *(int(x[i]) for x in (kept, removed, redundant, unique, good_lost, toxic_lost)), shapley[order[step - 1]])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", partitions: int | None = None) -> DataFrame:
    """What each filter does in each order, by part (see ``SCHEMA``); ``labels`` has ``id_col``, quality and toxic."""
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = masks(docs, id_col, text_col, part_col, partitions).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    flat = rows.join(marks, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(v: np.ndarray, x: tuple) -> np.ndarray:
        mask, n, good, toxic = x
        v[mask] += n
        v[MASKS + mask] += n * good
        v[2 * MASKS + mask] += n * toxic
        return v

    vectors = flat.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda x: add(np.zeros(3 * MASKS, dtype=np.int64), x), add, np.add)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: report(*x)), SCHEMA, verifySchema=False)
