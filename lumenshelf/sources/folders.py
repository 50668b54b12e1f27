"""Walking folders as a data source: listing is spread over tasks, filters decide before a file is looked at, and
what cannot be read is a row, not a failed scan."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from lumenshelf.functions.workers import ship

SCHEMA = "path string, extension string, size long, mtime long, error string"
#: Folders that the driver opens to find enough work for tasks, and files of a batch.
LISTED_AHEAD, BATCH_FILES = 64, 4096


@dataclass
class Below(InputPartition):
    """A folder to walk, relative to the root; with ``deep`` false only its own files."""

    folder: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, root: str, scopes: list[str]):
        self.root, self.scopes = root, scopes
        self.extensions: set[str] | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Extensions and path prefixes are settled by names alone: other files are never asked for size and time,
        and folders that cannot hold a match are not opened."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("extension",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.extensions = wanted if self.extensions is None else self.extensions & wanted
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            else:
                yield f

    def admits(self, path: str) -> bool:
        return (self.extensions is None or extension(path) in self.extensions) and all(path.startswith(p) for p in self.prefixes)

    def may_hold(self, folder: str) -> bool:
        inside = folder + "/" if folder else ""
        return all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes)

    def partitions(self) -> list[InputPartition]:
        """Folders of the upper levels, each a task's work; opened breadth first until there are enough."""
        waiting, parts, opened = [s.strip("/") for s in self.scopes], [], 0
        while waiting and opened < LISTED_AHEAD:
            folder = waiting.pop(0)
            opened += 1
            try:
                with os.scandir(os.path.join(self.root, folder)) as entries:
                    names = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
            except OSError:
                parts.append(Below(folder, True))  # its task will tell
                continue
            parts.append(Below(folder, False))
            waiting += [f"{folder}/{n}".lstrip("/") for n in names if self.may_hold(f"{folder}/{n}".lstrip("/"))]
        return parts + [Below(f, True) for f in waiting]

    def walk(self, part: Below) -> Iterator[tuple]:
        waiting = [part.folder]
        while waiting:
            folder = waiting.pop()
            try:
                with os.scandir(os.path.join(self.root, folder)) as found:
                    entries = sorted(found, key=lambda e: e.name)
            except OSError as error:
                yield folder, None, None, None, error.strerror or str(error)
                continue
            for entry in entries:
                path = f"{folder}/{entry.name}".lstrip("/")
                try:
                    if entry.is_dir(follow_symlinks=False):
                        if part.deep and self.may_hold(path):
                            waiting.append(path)
                    elif self.admits(path) and entry.is_file(follow_symlinks=False):
                        told = entry.stat(follow_symlinks=False)
                        yield path, extension(path), told.st_size, told.st_mtime_ns // 1_000_000, None
                except OSError as error:
                    yield path, extension(path), None, None, error.strerror or str(error)

    def read(self, partition: Below) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["path", "extension", "size", "mtime", "error"]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        for row in self.walk(partition):
            held.append(row)
            if len(held) == BATCH_FILES:
                yield make(held)
                held = []
        if held:
            yield make(held)


def extension(path: str) -> str | None:
    """The lower-case extension of a name that does not begin with its only dot."""
    stem, dot, tail = path.rpartition("/")[2].rpartition(".")
    return tail.lower() if dot and stem else None


class FolderSource(DataSource):
    """Files below a folder that all workers have mounted: path (relative), extension, size, mtime (ms) and error.

    Options: ``path``, and ``scopes``, relative folders by line, if only those are to be walked. A folder that cannot be opened
    gives one row with its path and the error.
    """

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        scopes = [s for s in self.options.get("scopes", "").split("\n") if s]
        return FolderReader(self.options["path"], scopes or [""])


def walk_folders(spark: SparkSession, root: str, scopes: list[str] | None = None) -> DataFrame:
    """FolderSource over a root; filters on extension and the beginning of path reach the listing."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    return spark.read.format("folders").option("path", root).option("scopes", "\n".join(scopes or [])).load()
