"""Line dedup by the intervals of a suffix array of line ids, in DataFrame operations only (operator 3).

Texts are sequences of line ids (128-bit hashes of lines without white space around them). A line
that occurs once can be in no repeated run, so only stretches of lines that occur twice or more go
on, and of those only stretches with ``min_words`` words. Their suffixes are ranked by distributed
prefix doubling: rank k orders suffixes by their first 2^k lines; rank k+1 sorts the distinct pairs
(rank k here, rank k 2^k lines on) by a range exchange and numbers them in that order. Blocks that
occur once get no rank and drop out. Doubling ends at the longest shortest run that has
``min_words`` words: deeper ranks decide nothing.

Suffixes whose common prefix is n lines or longer are an interval of the suffix array, and its name
is n and the ranks of the two blocks of 2^floor(log2 n) lines that cover the run's beginning and end.
For each suffix and each place where a run may end, the shortest run with ``min_words`` words is
looked at: a longer repeated run is the union of such runs, so what they cover together is exactly
the maximal repeated runs. Each occurrence but the first of its interval, in order of id and line, is
deleted. Intervals are named and not read off neighbours in a sorted array, so no table of suffixes
is sorted as a whole and no longest common prefix is stored as a number.

No window, join or aggregate gathers an interval: its first occurrence is a partially aggregated
minimum, and what is not first is told by a join on document and line, so a line that a third of all
rows share is no join key. Windows run within one document.

Edge cases. Null texts stay null and empty ones empty. Lines of white space count as lines without
words. Overlapping occurrences delete all but the first. Rows that repeat both id and text are one
document, and each of them gets its result; a null id sorts first. Extra columns stay as they are,
whatever their names: where ``removed_lines`` is one of them, the new column's name gets underscores.
An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.functions.names import free_name
from twinframe.sources.shared import discard, materialize

SPACE = " \t\r\f\x0b"
KEY = ["d1", "d2"]


def _doc_keys(id_col: str, text_col: str) -> dict:
    """128 bits that stand for a row's id and text; never null."""
    return {"d1": F.xxhash64(F.col(id_col), F.col(text_col)), "d2": F.xxhash64(F.lit(3), F.col(text_col), F.col(id_col))}


def _numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct rows with numbers that ascend in the order of ``by``, from a range exchange."""
    return df.orderBy(*by).withColumn(name, F.monotonically_increasing_id())


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line's place, hashes and number of words."""
    src = docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in _doc_keys(id_col, text_col).items()), F.col(text_col).alias("text_"))
    lines = src.filter(F.length("text_") > 0).select("id", *KEY, F.posexplode(F.split("text_", "\n")).alias("pos", "line"))
    bare = F.btrim(F.col("line"), F.lit(SPACE))
    return lines.select(
        "id", *KEY, "pos", F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(5), bare).alias("h2"),
        F.when(F.length(bare) == 0, 0).otherwise(F.size(F.split(bare, "\\s+"))).cast("long").alias("words"),
    )


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines of the stretches to look at, with rank 0 and the runs that begin at or end before each."""
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    seq = lines.join(_numbered(often, ["h1", "h2"], "r0"), ["h1", "h2"]).select("id", *KEY, "pos", "words", "r0")
    in_doc = Window.partitionBy(*KEY).orderBy("pos")
    seq = seq.withColumn("part", F.col("pos") - F.dense_rank().over(in_doc)).dropDuplicates([*KEY, "pos"])
    part = Window.partitionBy(*KEY, "part")
    seq = seq.withColumn("total", F.sum("words").over(part)).filter(F.col("total") >= min_words)
    ordered = part.orderBy("pos")
    seq = seq.withColumn("before", F.sum("words").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    by_words = part.orderBy("before")
    ahead = F.min("pos").over(by_words.rangeBetween(min_words, Window.unboundedFollowing))
    behind = F.max("pos").over(by_words.rangeBetween(Window.unboundedPreceding, -min_words))
    final = F.max("pos").over(part)
    fits = F.col("total") - F.col("before") >= min_words
    seq = seq.withColumns({
        "end": F.coalesce(ahead - 1, F.when(fits, final)),
        "ended_from": behind,
        "last_from": F.when(F.col("pos") == final, F.max(F.when(fits, F.col("pos"))).over(part)),
    })
    return seq.select("id", *KEY, "part", "pos", "r0", "end", "ended_from", "last_from")


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, d1, d2, start, size)``, a written table: every later occurrence of a shortest repeated run."""
    lines = materialize(_lines(docs, id_col, text_col), "lines")
    seq = materialize(_stretches(lines, min_words), "stretches")
    discard(lines)
    rows = seq.count()
    pos = F.col("pos")
    run = lambda a, b: F.struct(a.cast("int").alias("start"), (b - a + 1).cast("int").alias("size"))

    def found(seq: DataFrame) -> DataFrame:
        runs = seq.select("id", *KEY, F.explode(F.array(run(pos, F.col("end")), run(F.col("ended_from"), pos - 1), run(F.col("last_from"), pos))).alias("r"))
        return runs.select("id", *KEY, "r.start", "r.size").filter("start is not null and size > 0").distinct()

    depth = found(seq).agg(F.max("size")).first()[0]
    levels = (depth or 1).bit_length()

    row = Window.partitionBy(*KEY, "part").orderBy("pos")
    for k in range(levels - 1):
        here, step = f"r{k}", 1 << k
        # Suffixes that cannot match get keys of their own, spread over all partitions.
        alone = -1 - F.abs(F.xxhash64(*KEY, "pos") % (1 << 40))
        pairs = seq.withColumn("on", F.lead(here, step).over(row))
        known = pairs.filter(F.col(here).isNotNull() & F.col("on").isNotNull())
        ranks = known.groupBy(here, "on").agg(F.count("*").alias("n")).filter("n > 1").select(F.col(here).alias("a"), F.col("on").alias("b"))
        ranks = _numbered(ranks, ["a", "b"], f"r{k + 1}")
        pairs = pairs.withColumn("a", F.coalesce(here, alone)).withColumn("b", F.coalesce("on", alone)).drop("on")
        deeper = materialize(pairs.join(ranks, ["a", "b"], "left").drop("a", "b"), "ranks", rows)
        discard(seq)
        seq = deeper

    level = F.floor(F.log2("size") + 1e-9).cast("int")
    at_level = lambda p: F.element_at(F.array(*[F.col(f"{p}.r{k}") for k in range(levels)]), F.col("level") + 1)
    named = (
        found(seq).withColumn("level", level).alias("run")
        .join(seq.alias("s"), [*(F.col(f"run.{c}") == F.col(f"s.{c}") for c in KEY), F.col("run.start") == F.col("s.pos")])
        .join(seq.alias("e"), [*(F.col(f"run.{c}") == F.col(f"e.{c}") for c in KEY), F.col("run.start") + F.col("size") - F.pow(F.lit(2.0), F.col("level")).cast("int") == F.col("e.pos")])
        .select("run.id", *(f"run.{c}" for c in KEY), "run.start", "run.size", at_level("s").alias("a"), at_level("e").alias("b"))
        .filter("a is not null and b is not null")
    )
    named = materialize(named, "runs", 3 * rows)
    first = named.groupBy("size", "a", "b").agg(F.min(F.struct("id", "start", *KEY)).alias("first")).select(*(f"first.{c}" for c in KEY), "first.start", "size")
    later = materialize(named.join(first, [*KEY, "start", "size"], "left_anti").select("id", *KEY, "start", "size"), "later-runs", 3 * rows)
    discard(seq, named)
    return later


def line_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later copies of repeated runs taken out of the text, and the line numbers taken out as ``removed_lines``."""
    later = repeated_runs(docs, min_words, id_col, text_col)
    gone, k1, k2 = (free_name(docs, x) for x in ("gone_lines", "gone_key1", "gone_key2"))
    found = later.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos"))
    found = found.groupBy(*KEY).agg(F.array_sort(F.collect_set("pos")).alias(gone)).withColumnsRenamed({"d1": k1, "d2": k2})  # a document's lines
    key = _doc_keys(id_col, text_col)
    joined = docs.join(found, (key["d1"] == F.col(k1)) & (key["d2"] == F.col(k2)), "left")
    lines = F.split(text_col, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    removed = F.coalesce(gone, F.array().cast("array<int>")).alias(free_name(docs, "removed_lines"))
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), removed)
