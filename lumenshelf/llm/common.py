"""Helpers that the corpus operators share: inputs, lineage cuts, size-checked broadcasts, skew-proof joins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenshelf.functions.storage import shared_folder
from lumenshelf.functions.workers import map_arrow

#: Rows of a narrow key table that may be sent to every executor. Larger tables are joined by shuffle.
MAX_BROADCAST_ROWS = 200_000
#: Bytes of such a table whose rows are wide.
MAX_BROADCAST_BYTES = 16 << 20

#: White space of the contracts: the ASCII characters 9 to 13 and 32.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and forget its lineage.

    The folder is spark.checkpoint.dir; see shared_folder where that is unset.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def sized(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Materialise a key table and count it: a broadcast hint if it is small enough, and whether it is."""
    df = cut(df)
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def id_key(column: str = "doc_id") -> Column:
    """A join key for ids that never is null: ids are numbers, so the empty string is free for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def set_apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns that no helper column can clash with, and their names by the names they had."""
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def given_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of set_apart alone, under the names they had."""
    return df.select(*[F.col(now).alias(name) for name, now in names.items()])


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of many rows with one row per group, safe when one group holds most of the rows.

    groups has ``key`` (unique, never null), ``size`` and values. Groups with over a thousandth of all
    rows are fewer than a thousand, so those are broadcast; their rows then take part in the shuffle
    under keys spread by ``spread``, which match nothing.
    """
    values = [c for c in groups.columns if c != key]
    heavy = groups.where(F.col(size) * 1000 > total)
    light = groups.where(F.col(size) * 1000 <= total)
    first = rows.join(F.broadcast(heavy.select(F.col(key), *[F.col(c).alias(f"_h_{c}") for c in values])), key, "left")
    first = first.withColumn("_k", F.when(F.col(f"_h_{size}").isNotNull(), F.concat(F.col(key).cast("string"), F.lit("#"), F.abs(F.xxhash64(spread)).cast("string"))).otherwise(F.col(key).cast("string")))
    second = light.select(F.col(key).cast("string").alias("_k"), *[F.col(c).alias(f"_l_{c}") for c in values])
    joined = first.join(second, "_k", "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in values])


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Any]], schema: str, inputs: list[str]) -> DataFrame:
    """Run ``make()(*row values)`` once per row inside Arrow batches; it returns the output tuple.

    ``make`` is called once per task, so that tables and caches are built there and not per row.
    """
    from pyspark.sql.types import _parse_datatype_string

    out_type = _parse_datatype_string(schema)
    names = out_type.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, each = to_arrow_schema(out_type), make()
        for batch in batches:
            # A batch of long texts is worked through in slices, so that outputs stay small too.
            for at in range(0, batch.num_rows, 1000):
                columns = [c.to_pylist() for c in batch.slice(at, 1000).columns]
                rows = [each(*values) for values in zip(*columns)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], arrow.field(k).type) for k in range(len(names))], schema=arrow)

    return map_arrow(df.select(*inputs), run, schema)
