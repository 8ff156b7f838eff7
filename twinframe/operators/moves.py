"""Move plans. Spark plans; a driver-side function moves.

Names are free of collisions: name.ext, name_1.ext up to name_100.ext, the first that is neither on
disk nor taken by a file before it in the order of the plan. Files claim names in rounds. Each claims
the first name that it may still get, a name goes to the first in order of those that claim it, and
who loses goes on to the next name; a file that holds a name loses it when an earlier one comes to
claim it. When nobody loses, every file has the name that it would have got in turn.

Files of the same name have the same list of names and get them in order, each a later one than the file
before it. So the k-th of them begins at the k-th name of the list, those beyond the last name fail
without a claim, and only as many as the list has names take part: a name that very many files share
costs one task no more than that, and numbered files of one family are as many lists as there are names.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.functions.paths import basename, extension, stem
from twinframe.sources.shared import discard, materialize

TRIES = 100


def plan_names(names: list[str], existing: set[str]) -> list[str | None]:
    """Free names for files in this order; None where all are taken."""
    taken, out = set(existing), []
    for name in names:
        root, ext = os.path.splitext(name)
        free = next((x for x in (name, *(f"{root}_{i}{ext}" for i in range(1, TRIES + 1))) if x not in taken), None)
        out.append(free)
        if free:
            taken.add(free)
    return out


def _taken(existing: DataFrame) -> DataFrame:
    """``(stem, ext, taken)``: for each list of names the places that files on disk hold."""
    name = existing.select(stem(F.col("name")).alias("stem"), extension(F.col("name")).alias("ext"))
    number = F.regexp_extract("stem", r"^(.*)_([1-9][0-9]{0,2})$", 2)
    places = F.array(F.struct("stem", F.lit("0").alias("place")), F.struct(F.regexp_extract("stem", r"^(.*)_([1-9][0-9]{0,2})$", 1).alias("stem"), number.alias("place")))
    rows = name.select("ext", F.explode(places).alias("p")).filter("p.place != ''").select("p.stem", "ext", F.col("p.place").cast("int").alias("place"))
    return rows.filter(F.col("place") <= TRIES).groupBy("stem", "ext").agg(F.collect_set("place").alias("taken"))  # TRIES + 1 at most


def _claims(src: DataFrame, there: DataFrame) -> DataFrame:
    """``(id, dest_name)`` of the files that get a name."""
    in_order = Window.partitionBy("stem", "ext").orderBy("seq", "path", "id")
    now = src.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= TRIES + 1)
    free = F.array_except(F.sequence(F.lit(0), F.lit(TRIES)), F.coalesce("taken", F.array().cast("array<int>")))
    now = now.join(_taken(there), ["stem", "ext"], "left").withColumn("free", free).drop("taken").withColumn("at", F.col("rank") - 1)
    now = materialize(now.select("id", "seq", "path", "stem", "ext", "rank", "free", "at"), "claims")
    place = F.get("free", F.col("at"))
    claimed = F.when(place == 0, F.concat("stem", "ext")).otherwise(F.concat("stem", F.lit("_"), place.cast("string"), "ext"))
    order = F.struct("moves", "seq", "path", "id")
    held = there.select("name", F.lit(False).alias("moves"), *(F.lit(None).cast(t).alias(c) for c, t in (("seq", "bigint"), ("path", "string"), ("id", "bigint"))))
    while True:
        # Two lists at most can come to one name, and each claims a name once.
        asked = now.filter(place.isNotNull()).select(claimed.alias("name"), F.lit(True).alias("moves"), "seq", "path", "id").unionByName(held)
        lost = asked.withColumn("first", F.min(order).over(Window.partitionBy("name"))).filter(F.col("moves") & (F.col("first.id").isNull() | (F.col("first.id") != F.col("id"))))
        lost = materialize(lost.select("id", F.lit(1).alias("lost")), "lost-claims")
        if lost.isEmpty():
            return now.filter(place.isNotNull()).select("id", claimed.alias("dest_name"))
        # Each begins after the one before it.
        at = F.col("at") + F.coalesce("lost", F.lit(0))
        before = Window.partitionBy("stem", "ext").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        moved = now.join(lost, "id", "left").withColumn("at", F.max(at - F.col("rank")).over(before) + F.col("rank")).drop("lost")
        later = materialize(moved, "claims")
        discard(now, lost)
        now = later


def move_plan(files: DataFrame, folder: str, existing: DataFrame | None = None, rename: bool = True) -> DataFrame:
    """``(src, dest, action, status)`` of ``files(path, seq)``, in the order of seq and path; ``existing(name)`` is in the folder already.

    Without ``rename`` a name that is taken is a failure.
    """
    src = files.select("path", F.col("seq").cast("long").alias("seq"), basename("path").alias("name"))
    src = materialize(src.select("*", stem(F.col("name")).alias("stem"), extension(F.col("name")).alias("ext"), F.monotonically_increasing_id().alias("id")), "moves")
    there = (src.limit(0) if existing is None else existing).select("name").distinct()
    if rename:
        got = _claims(src, there)
    else:
        first = src.groupBy("name").agg(F.min(F.struct("seq", "path", "id"))["id"].alias("id"))
        got = first.join(there, "name", "left_anti").select("id", F.col("name").alias("dest_name"))
    out = src.join(got, "id", "left")
    return out.select(
        F.col("path").alias("src"), F.concat(F.lit(f"{folder}/"), "dest_name").alias("dest"), F.lit("move").alias("action"), F.when(F.col("dest_name").isNull(), "failed").otherwise("planned").alias("status")
    )


class Journal:
    """A plan that is being carried out, and what has been done of it, in a folder of its own.

    The plan is stored before the first move, and moves are noted before they begin, many at once, and each after it ended. A run
    that was stopped goes on from there, and ends with the files and counts of one that was not.
    """

    def __init__(self, folder: str):
        self.folder, self.plan, self.log = folder, os.path.join(folder, "plan"), os.path.join(folder, "log")

    def exists(self) -> bool:
        return os.path.exists(self.plan)

    def store(self, plan: DataFrame) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(self.plan + ".draft", "w", encoding="utf-8") as f:
            for r in plan.toLocalIterator():
                f.write(json.dumps([r["src"], r["dest"], r["status"]]) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(self.plan + ".draft", self.plan)

    def read(self) -> tuple[Iterator[tuple[str, str | None, str]], dict[int, str]]:
        """The plan's rows, and the last word on each that was begun: "begun", "moved" or "failed"."""
        said: dict[int, str] = {}
        if os.path.exists(self.log):
            with open(self.log, encoding="utf-8") as f:
                for line in f:
                    x = line.split()
                    if line.endswith("\n") and len(x) == 2 and x[1] in ("begun", "moved", "failed"):  # else it was cut off
                        said[int(x[0])] = x[1]
        return (tuple(json.loads(x)) for x in open(self.plan, encoding="utf-8")), said

    def end(self) -> None:
        shutil.rmtree(self.folder)


def _move(src: str, dest: str) -> bool:
    try:
        os.makedirs(os.path.dirname(dest), exist_ok=True)
        shutil.move(src, dest)
        return True
    except OSError:
        return False


def _can_move(src: str, dest: str | None, status: str) -> bool:
    return status == "planned" and dest is not None and os.path.isabs(src) and os.path.exists(src) and not os.path.exists(dest)


def apply_moves(plan: DataFrame, journal: str | None = None) -> tuple[int, int, set[str]]:
    """Moves what is planned, from the driver: numbers of files moved and failed, and the paths moved.

    ``journal`` is a folder for a ``Journal``; an unfinished one there is finished first, and counts too.
    """
    if journal is None:
        rows = ((r["src"], r["dest"], r["status"]) for r in plan.toLocalIterator())
        done = [(src, _can_move(src, dest, status) and _move(src, dest)) for src, dest, status in rows]
        moved = {src for src, ok in done if ok}
        return len(moved), len(done) - len(moved), moved
    before = resume_moves(journal)
    Journal(journal).store(plan)
    after = resume_moves(journal)
    return before[0] + after[0], before[1] + after[1], before[2] | after[2]


def resume_moves(journal: str, together: int = 1000) -> tuple[int, int, set[str]]:
    """Finish what a journal says; the counts are those of the whole plan. Without a journal nothing is done.

    ``together`` moves are noted as begun at once, when all their names are free, with one wait for the disk. They are
    done in order, so of those begun only the first whose file is still there can have left half a copy.
    """
    book, moved, failed = Journal(journal), set(), 0
    if not book.exists():
        return 0, 0, moved
    rows, said = book.read()
    with open(book.log, "a", encoding="utf-8") as log:

        def keep() -> None:
            log.flush()
            os.fsync(log.fileno())

        def say(i: int, src: str, word: str) -> None:
            nonlocal failed
            log.write(f"{i} {word}\n")
            log.flush()
            failed += word == "failed"
            if word == "moved":
                moved.add(src)

        def carry_out() -> None:
            log.writelines(f"{i} begun\n" for i, _, _ in begun)
            keep()
            for i, src, dest in begun:
                ok = _can_move(src, dest, "planned") and _move(src, dest)
                say(i, src, "moved" if ok else "failed")
                if not ok:
                    keep()  # its file is still there
            begun.clear()

        log.write("" if os.path.getsize(book.log) == 0 else "\n" * _cut_off(book.log))
        begun: list[tuple[int, str, str]] = []
        halves = True
        for i, (src, dest, status) in enumerate(rows):
            word = said.get(i)
            if word == "begun":
                if not os.path.exists(src):
                    word = "moved" if os.path.exists(dest) else "failed"
                elif halves:
                    halves = False
                    if os.path.exists(dest):  # the name was free then: what is there now is this move's
                        os.remove(dest)  # half a copy
            if word in ("moved", "failed"):
                say(i, src, word)
                continue
            if begun and not _can_move(src, dest, status):
                carry_out()  # a move before it may make it possible
            if _can_move(src, dest, status):
                begun.append((i, src, dest))
                if len(begun) == together:
                    carry_out()
            else:
                say(i, src, "failed")
        if begun:
            carry_out()
    book.end()
    return len(moved), failed, moved


def _cut_off(path: str) -> bool:
    """Whether a file ends within a line."""
    with open(path, "rb") as f:
        f.seek(-1, os.SEEK_END)
        return f.read(1) != b"\n"
