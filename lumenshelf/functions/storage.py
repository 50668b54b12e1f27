"""The folder for intermediate tables that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this machine serves a local
    master, as in tests; on a cluster that is an error, since executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(context, "_lumenshelf_folder", None):
        context._lumenshelf_folder = tempfile.mkdtemp(prefix="lumenshelf-")
    return context._lumenshelf_folder


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(rows: DataFrame, **options: int) -> DataFrame:
    """Rows written to the shared folder and read again, without the plan that made them."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    rows.write.options(**options).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def short_scans(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs within read at most so many bytes of files in a task, or one row group. A shuffle to over 200 partitions
    (spark.shuffle.sort.bypassMergeThreshold) holds all rows of a task that it is given."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, old)


class Conflict(RuntimeError):
    """Another writer has taken the version that this one wanted to publish."""


class Versions:
    """A folder of immutable parts, each version of it told by a manifest (JSON) that appears at once.

    Parts are written first, by Spark, under names of their own; a manifest then names those that make up
    the version. Readers hold on to the manifest they began with, so a later version changes nothing for
    them until ``clean`` removes what only older versions name. A writer claims the next number before it
    publishes; of two writers that started from one version the second gets a Conflict.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(self, folder: str = "") -> list[str]:
        at = self.path(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.listed() if n.startswith("manifest-") and n.endswith(".json"))

    def read(self, number: int) -> dict:
        stream = self.files.open(self.path(f"{self.folder}/manifest-{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> dict | None:
        """The manifest of the newest version, with its number; None before the first."""
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def publish(self, manifest: dict, after: int) -> dict:
        """Make the version that follows number ``after``."""
        number = after + 1
        claim = self.path(f"{self.folder}/claim-{number}")
        if number in self.numbers() or not self.claimed(claim):
            raise Conflict(f"version {number} of {self.folder} is taken")
        told = manifest | {"number": number}
        draft = self.path(f"{self.folder}/draft-{uuid.uuid4().hex}")
        out = self.files.create(draft, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if not self.files.rename(draft, self.path(f"{self.folder}/manifest-{number}.json")):
            raise Conflict(f"version {number} of {self.folder} is taken")
        return told

    def claimed(self, claim) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            self.files.create(claim, False).close()
        except Py4JJavaError:
            return False
        return True

    def part(self, kind: str) -> str:
        """A fresh name for a part, below the folder."""
        return f"{kind}-{uuid.uuid4().hex}"

    def at(self, part: str) -> str:
        return f"{self.folder}/{part}"

    def clean(self, keep: int = 2) -> None:
        """Remove manifests older than the last ``keep``, and parts that none of those names."""
        numbers = self.numbers()
        named = {p for n in numbers[-keep:] for p in parts_of(self.read(n))}
        for n in numbers[:-keep]:
            self.files.delete(self.path(f"{self.folder}/manifest-{n}.json"), False)
        for name in self.listed():
            if not name.startswith(("manifest-", "claim-", "draft-", ".")) and name not in named:
                self.files.delete(self.path(f"{self.folder}/{name}"), True)


def parts_of(manifest) -> list[str]:
    """Every string of a manifest, of which the names of parts are some."""
    if isinstance(manifest, str):
        return [manifest]
    values = manifest.values() if isinstance(manifest, dict) else manifest if isinstance(manifest, list) else []
    return [p for v in values for p in parts_of(v)]
