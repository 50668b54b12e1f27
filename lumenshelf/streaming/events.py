"""The change feed as a stream: topics, visibility, lag, debounced watching, kept counts, job state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenshelf.functions.storage import shared_folder

QUIET, MANY_PATHS = "600 milliseconds", 512
FIRST_POLL_S, LAST_POLL_S, JITTER = 15, 900, 0.1


def change_feed(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stream over an append-only table of events. Event time becomes a timestamp for watermarks."""
    schema = schema or spark.read.parquet(path).schema
    # A table may be a file or a folder; the pattern names either, and both are listed again for news.
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there, appending to files, and read the result."""
    out = fresh_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def drained_state(stream: DataFrame) -> DataFrame:
    """The final state of a streaming aggregate: each batch rewrites a new version, the last one counts."""
    spark, out = stream.sparkSession, fresh_folder(stream.sparkSession)
    versions: list[int] = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version-{number}")
        versions.append(number)

    stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/version-{versions[-1]}") if versions else spark.createDataFrame([], stream.schema)


def on_topics(events: DataFrame, topics: list[str]) -> DataFrame:
    return events.where(F.col("event_type").isin(topics)) if topics else events


def seen_events(events: DataFrame, sources: list[int], source: Column) -> DataFrame:
    """Events of visible sources; an event that names none is for all to see."""
    return events.where(source.isNull() | source.isin(sources))


def job_visible(sources: Column, collections: Column, may_sources: list[str], may_collections: list[int]) -> Column:
    """A job shows if all sources and collections it names are visible, and it names any."""
    ok = lambda c, may: F.forall(c, lambda x: x.isin(may) if may else F.lit(False))
    return (F.size(sources) + F.size(collections) > 0) & ok(sources, may_sources) & ok(collections, may_collections)


def lag_markers(batches: DataFrame) -> DataFrame:
    """Where a consumer's batches (consumer, first, last) leave a gap: how many events it missed."""
    before = F.lag("last").over(Window.partitionBy("consumer").orderBy("first"))
    rows = batches.withColumn("missed", F.col("first") - before - 1)
    return rows.where(F.col("missed") > 0).select("consumer", F.col("first").alias("resume_at"), "missed")


def debounced(changes: DataFrame, key: str, quiet: str = QUIET) -> DataFrame:
    """Bursts of changes (ts, key, path) that a quiet time ends: their span, size, and whether so many
    paths changed that the whole source is listed again. Works on streams with a watermark too."""
    burst = changes.groupBy(F.session_window("ts", quiet).alias("w"), key)
    out = burst.agg(F.count(F.lit(1)).alias("changes"), F.approx_count_distinct("path").alias("paths") if changes.isStreaming else F.count_distinct("path").alias("paths"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes", "paths", (F.col("paths") > MANY_PATHS).alias("rescan"))


def next_poll(previous_s: Column, changed: Column, source: Column) -> Column:
    """Seconds to the next poll: doubled while nothing changes, with a jitter that is stable per source."""
    base = F.when(changed, F.lit(FIRST_POLL_S)).otherwise(F.least(previous_s * 2, F.lit(LAST_POLL_S)))
    share = F.conv(F.substring(F.md5(source), 1, 4), 16, 10).cast("int") % 1000
    return F.round(base * (1 + F.lit(JITTER) * share / 1000), 3)


def kept_counts(events: DataFrame) -> DataFrame:
    """Counts per topic, kept up by the stream."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 10).alias("large"))


def flush_groups(rows: DataFrame, size: str, key: str, order: str, most_rows: int = 64, most_bytes: int = 8 << 20) -> DataFrame:
    """Batches of a writer: by rows, and by bytes within these, in order per key."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("_by_rows", F.floor((F.row_number().over(w) - 1) / most_rows))
    inner = Window.partitionBy(key, "_by_rows").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    filled = numbered.withColumn("_by_bytes", F.floor(F.coalesce(F.sum(size).over(inner), F.lit(0)) / most_bytes))
    return filled.groupBy(key, F.col("_by_rows").alias("rows_part"), F.col("_by_bytes").alias("bytes_part")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


def job_state(updates: DataFrame) -> DataFrame:
    """The state of each job from its updates (job, version, state, done, total): the latest version,
    but a cancellation beats a later done."""
    cancelled = F.max(F.col("state") == "cancelled")
    last = F.max_by(F.struct("state", "done", "total"), "version")
    rows = updates.groupBy("job").agg(cancelled.alias("c"), last.alias("l"))
    state = F.when(F.col("c"), F.lit("cancelled")).otherwise(F.col("l.state"))
    return rows.select("job", state.alias("state"), F.col("l.done").alias("done"), F.when(F.col("l.total") > 0, F.round(F.col("l.done") / F.col("l.total"), 6)).alias("progress"))


# Extensions beyond the catalogue's own semantics: event-time windows with late data.


def windowed_counts(events: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "5 minutes") -> DataFrame:
    """Events per tumbling or sliding window and topic; on a stream, late events count up to the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")
