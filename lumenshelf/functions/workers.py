"""Running Python in tasks: Arrow batches, and this package on every worker."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Let workers import this package: Spark sends them a copy, unless their path already has it."""
    context = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) in paths or getattr(context, "_lumenshelf_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "lumenshelf.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((ROOT / "lumenshelf").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    context.addPyFile(archive)
    context._lumenshelf_shipped = True


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with the package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def in_parts(batches: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows, where each row becomes Python objects or large arrays for a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def group_arrow(df: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    """df.groupBy(keys).applyInArrow with the package at hand. The plan itself demands that a group comes
    whole to one task; a repartition ahead of map_arrow may be optimised away."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, schema)
