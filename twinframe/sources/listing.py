"""Directory listings as DataFrames.

A Python data source. The driver opens folders level by level until it knows ``folders`` of them (256 by
default), which become partitions, so that large trees are walked by many tasks even where the first
levels are narrow. Conditions on a path's beginning prune folders before they are opened, and those on
sizes and times are tested before a row is made. Files in folders that executors cannot see are not
found; errors end a folder's listing, not the query.
"""

from __future__ import annotations

import operator
import os
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from twinframe.params import CACHE_NAME, MEDIA_EXTENSIONS, RESERVED_FOLDERS

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
COLUMNS = ("path", "mtime", "size_bytes")
#: Conditions that the lister tests itself.
TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


def _media(name: str) -> bool:
    return os.path.splitext(name)[1].lower() in MEDIA_EXTENSIONS


def _row(path: str):
    try:
        s = os.stat(path)
        return (path, s.st_mtime, s.st_size), s.st_ctime
    except OSError:
        return None


class _Reader(DataSourceReader):
    def __init__(self, root: str, recursive: bool, folders: int):
        self.root, self.recursive, self.folders = os.path.abspath(root), recursive, folders
        self.begins: list[str] = []
        self.tests: list[tuple[int, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at = COLUMNS.index(f.attribute[0]) if getattr(f, "attribute", None) and f.attribute[0] in COLUMNS else None
            if at == 0 and isinstance(f, StringStartsWith):
                self.begins.append(f.value)
            elif at is not None and type(f) in TESTS and f.value is not None:
                self.tests.append((at, type(f), f.value))
            elif not (at is not None and isinstance(f, IsNotNull)):  # no column is ever null
                yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether paths below a folder can begin as they have to."""
        below = folder.rstrip("/") + "/"
        return all(below.startswith(b) or b.startswith(below) for b in self.begins)

    def _below(self, folder: str) -> list[str]:
        try:
            with os.scandir(folder) as found:
                return [e.path for e in found if e.is_dir(follow_symlinks=False) and e.name not in RESERVED_FOLDERS and self._may_hold(e.path)]
        except OSError:
            return []

    def partitions(self):
        out, level = [], [self.root] if self._may_hold(self.root) else []
        while self.recursive and level and len(out) + len(level) < self.folders:
            out += [Folder(f, False) for f in level]
            level = [x for f in level for x in self._below(f)]
        return out + [Folder(f, self.recursive) for f in level]

    def read(self, partition) -> Iterator[tuple]:
        return (row for row, _ in self.found(partition))

    def found(self, partition) -> Iterator[tuple[tuple, float]]:
        """Rows, each with the time at which the file came into being, was moved here or was changed last."""
        try:
            for folder, below, names in os.walk(partition.path):
                below[:] = [x for x in below if x not in RESERVED_FOLDERS and self._may_hold(os.path.join(folder, x))] if partition.deep else []
                for x in names:
                    path = os.path.join(folder, x)
                    if not _media(x) or not all(path.startswith(b) for b in self.begins) or not (self.recursive or os.path.isfile(path)):
                        continue
                    row = _row(path)
                    if row and all(TESTS[kind](row[0][at], value) for at, kind, value in self.tests):
                        yield row
        except OSError:
            return


class Between(Folder):
    """What a folder got after one time and up to another."""

    def __init__(self, folder: Folder, after: float, until: float):
        super().__init__(folder.path, folder.deep)
        self.after, self.until = after, until


class _StreamReader(DataSourceStreamReader):
    """Offsets are times: a batch has the files that came, were moved here or were changed between two of them."""

    def __init__(self, reader: _Reader, lag: float):
        self.reader, self.lag = reader, lag

    def initialOffset(self) -> dict:
        return {"until": 0.0}

    def latestOffset(self) -> dict:
        return {"until": time.time() - self.lag}

    def partitions(self, start: dict, end: dict):
        return [Between(f, start["until"], end["until"]) for f in self.reader.partitions()]

    def read(self, partition) -> Iterator[tuple]:
        return (row for row, at in self.reader.found(partition) if partition.after < at <= partition.until)


class MediaFiles(DataSource):
    """``spark.read.format("media_files").option("recursive", "true").load(folder)``; the session has to allow pushed filters (``PUSHDOWN``).

    As a stream, ``lag`` seconds (1 by default) are waited for clocks that differ and for changes that are not seen at once.
    """

    @classmethod
    def name(cls):
        return "media_files"

    def schema(self):
        return "path string, mtime double, size_bytes bigint"

    def streamReader(self, schema):
        return _StreamReader(self.reader(schema), float(self.options.get("lag", "1")))

    def reader(self, schema):
        return _Reader(self.options["path"], str(self.options.get("recursive", "false")).lower() == "true", int(self.options.get("folders", "256")))


def list_media(spark: SparkSession, folder: str, recursive: bool = False, folders: int = 256) -> DataFrame:
    """``(path, mtime, size_bytes)`` of the media files in a folder; none if it cannot be read."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(MediaFiles)
    return spark.read.format("media_files").option("recursive", str(recursive).lower()).option("folders", str(folders)).load(os.path.abspath(folder))


def stream_media(spark: SparkSession, folder: str, recursive: bool = False, lag: float = 1.0) -> DataFrame:
    """A stream of the same rows: each file when it comes and whenever it changes."""
    spark.dataSource.register(MediaFiles)
    return spark.readStream.format("media_files").option("recursive", str(recursive).lower()).option("lag", str(lag)).load(os.path.abspath(folder))


def cache_path(folder: str, name: str = CACHE_NAME) -> str:
    return os.path.abspath(os.path.join(folder, name))
