"""Incremental maintenance: merging listings, scan generations, the pending queue, analysis plans.

Tables are immutable, so each operation maps old tables to new ones; a caller writes them as a new version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenshelf.functions.storage import settled

PIPELINE_VERSION, RETRY_MS, PENDING_BATCH, PLAN_BATCH = 3, 30_000, 128, 512
VISUAL = ("image", "video", "model")
KEY = ["source_id", "path"]


def with_new_ids(rows: DataFrame, greatest: int) -> DataFrame:
    """Rows whose null ids follow ``greatest``, in order of a hash of source and path.

    Numbers are counted per first digits of the hash, on top of the pieces before, so no task numbers all.
    """
    fresh = F.col("id").isNull()
    keyed = rows.where(fresh).withColumn("_order", F.md5(F.concat_ws("/", *KEY))).withColumn("_piece", F.substring("_order", 1, 3))
    pieces = keyed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_rows"))  # 4096 at most
    starts = pieces.select("_piece", F.coalesce(F.sum("_rows").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_piece").orderBy("_order", *KEY))
    new = keyed.withColumn("_place", place).join(F.broadcast(starts), "_piece").withColumn("id", F.lit(greatest) + F.col("_start") + F.col("_place"))
    return rows.where(~fresh).unionByName(new.select(*rows.columns))


def upsert(assets: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """The asset table after a batch of observed files (columns of the scan), keyed by source and path.

    New content (a known hash that changed) or another media type reopens the analysis, and any other hash
    the derivatives; a seen file is no longer missing. Columns that a scan does not know stay. Of incoming
    rows that repeat a key the last scanned counts, then the greatest by hash. New ids follow the greatest
    old one. ``reclassified`` marks assets whose media type changed: see derived_kept.
    """
    seen = ["content_hash", "filename", "size_bytes", "modified_at", "scanned_at", "media_type", "format"]
    last = incoming.groupBy(*KEY).agg(F.max(F.struct("scanned_at", "content_hash", *[c for c in seen if c not in ("scanned_at", "content_hash")])).alias("_row"))
    new = last.select(*KEY, *[F.col(f"_row.{c}").alias(f"n_{c}") for c in seen], F.lit(True).alias("_new"))
    both = assets.withColumn("_old", F.lit(True)).join(new, KEY, "full")
    met = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    changed = F.col("content_hash").isNotNull() & F.col("n_content_hash").isNotNull() & (F.col("content_hash") != F.col("n_content_hash"))
    reclassified = met & (F.col("media_type") != F.col("n_media_type"))
    remade = (met & changed) | reclassified
    redrawn = reclassified | (met & ~F.col("content_hash").eqNullSafe(F.col("n_content_hash")))
    fresh = F.col("_new").isNotNull() & F.col("_old").isNull()
    out = both.select(
        "id", *KEY, *[F.when(F.col("_new").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in seen],
        F.when(remade | fresh, F.lit(0)).otherwise(F.col("analysis_version")).cast("int").alias("analysis_version"), F.when(~remade, F.col("analysed_at")).alias("analysed_at"),
        F.when(redrawn | fresh, F.lit(0)).otherwise(F.col("derivative_version")).cast("int").alias("derivative_version"),
        F.when(fresh, F.lit(0)).when(F.col("_new").isNotNull(), F.col("flags").bitwiseAND(-2)).otherwise(F.col("flags")).cast("int").alias("flags"),
        F.when(fresh, F.lit("new")).when(remade, F.lit("remade")).when(F.col("_new").isNotNull(), F.lit("seen")).otherwise(F.lit("kept")).alias("outcome"), reclassified.alias("reclassified"),
    )
    out = settled(out)  # the join is made once, for the greatest id, the old rows and the new ones
    return with_new_ids(out, out.agg(F.max("id")).first()[0] or 0)


def derived_kept(rows: DataFrame, after: DataFrame, media: str | None = None) -> DataFrame:
    """Attribute rows (asset_id) of a media type, or embeddings, that survive an upsert: a reclassified asset
    keeps only attributes of its new type, and no embedding."""
    lost = after.where("reclassified") if media is None else after.where(F.col("reclassified") & (F.col("media_type") != media))
    return rows.join(lost.select(F.col("id").alias("asset_id")), "asset_id", "left_anti")


def begun(scans: DataFrame, source: str) -> DataFrame:
    """The scans (source_id, generation) after a new one of ``source`` began; a source without any starts at 1."""
    asked = scans.sparkSession.range(1).select(F.lit(source).alias("source_id"), F.lit(1).alias("_asked"))
    rows = scans.join(asked, "source_id", "full")
    return rows.select("source_id", (F.coalesce("generation", F.lit(0)) + F.coalesce("_asked", F.lit(0))).cast("int").alias("generation"))


def observe(assets: DataFrame, seen: DataFrame) -> DataFrame:
    """The assets that a scan met, no longer missing: id and flags."""
    return assets.join(seen.select(*KEY).distinct(), KEY, "left_semi").select("id", F.col("flags").bitwiseAND(-2).alias("flags"))


def scan_batches(listing: DataFrame, size: int = PENDING_BATCH) -> DataFrame:
    """Files in batches of ``size`` per source, in order of path, each one transaction: the batch's number."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("path")) - 1
    return listing.withColumn("batch", F.floor(place / size).cast("long"))


def analysed(assets: DataFrame, results: DataFrame, version: int, now: int) -> DataFrame:
    """Assets after analysis results (id, error): those without an error are done at ``version``."""
    both = assets.join(results.select("id", "error", F.lit(True).alias("_done")), "id", "left")
    good = F.col("_done").isNotNull() & F.col("error").isNull()
    return both.select("id", F.when(good, F.lit(version)).otherwise(F.col("analysis_version")).alias("analysis_version"), F.when(good, F.lit(now)).otherwise(F.col("analysed_at")).alias("analysed_at"), "error")


def unchanged() -> Column:
    """Size and time equal, and the time known: a file without a time is always looked at again."""
    return F.col("mtime").isNotNull() & F.col("size").eqNullSafe(F.col("seen_size")) & F.col("mtime").eqNullSafe(F.col("seen_mtime"))


def mark_missing(assets: DataFrame, observed: DataFrame, source: str, generation: int, current: int, scopes: list[str] | None = None) -> DataFrame:
    """Assets that a finished scan did not see, inside its scopes, get bit 0. A scan that a later one
    has overtaken marks nothing."""
    gone = assets.where((F.col("source_id") == source) & (F.col("flags").bitwiseAND(1) == 0))
    if scopes is not None:
        inside = [(F.col("path") == s) | ((F.col("path") >= s + "/") & (F.col("path") < s + "0")) for s in scopes]
        gone = gone.where(reduce(lambda a, b: a | b, inside, F.lit(False)))
    if generation != current:
        gone = gone.where(F.lit(False))
    lost = gone.join(observed, KEY, "left_anti").select("id", F.lit(1).alias("_bit"))
    return assets.join(lost, "id", "left").select("id", F.col("flags").bitwiseOR(F.coalesce("_bit", F.lit(0))).alias("flags"))


def quick_discovery(assets: DataFrame, pending: DataFrame, listing: DataFrame) -> DataFrame:
    """The listed files (source_id, path, size, mtime) to queue, and whether an asset loses what was
    derived from its old bytes: a file already pending with the same token, or verified with it, is left."""
    waits = pending.select(*KEY, F.col("size").alias("p_size"), F.col("mtime").alias("p_mtime"), F.lit(True).alias("_waits"))
    known = assets.select(*KEY, "id", F.col("size_bytes").alias("a_size"), F.col("modified_at").alias("a_mtime"), F.col("content_hash").isNotNull().alias("verified"))
    rows = listing.join(waits, KEY, "left").join(known, KEY, "left")
    same = lambda p: F.col("size").eqNullSafe(F.col(f"{p}_size")) & F.col("mtime").eqNullSafe(F.col(f"{p}_mtime"))
    left = F.col("mtime").isNotNull() & F.when(F.col("_waits").isNotNull(), same("p")).otherwise(F.coalesce("verified", F.lit(False)) & same("a"))
    return rows.where(~left).select(*KEY, "size", "mtime", F.col("id").alias("invalidated"))


def surviving_tags(tags: DataFrame, invalidated: DataFrame) -> DataFrame:
    """Tags after assets lost their derived rows: what users said and what was rejected stays."""
    lost = tags.where("source <> 'user' AND state <> 'rejected'").join(invalidated.select(F.col("invalidated").alias("asset_id")).where("asset_id IS NOT NULL"), "asset_id", "left_semi")
    return tags.join(lost.select("asset_id", "tag_id"), ["asset_id", "tag_id"], "left_anti")


def pending_page(pending: DataFrame, source: str, now: int, after: str | None = None, limit: int = PENDING_BATCH) -> DataFrame:
    rows = pending.where((F.col("source_id") == source) & (F.coalesce("retry_after", F.lit(0)) <= now))
    if after is not None:
        rows = rows.where(F.col("path") > after)
    return rows.orderBy("path").limit(min(limit, PENDING_BATCH))


def pending_commit(pending: DataFrame, results: DataFrame, blocked: DataFrame) -> DataFrame:
    """What becomes of finished work (source_id, path, revision, content_hash, cancelled): only the
    revision that is still pending is written."""
    hit = blocked.select("content_hash").distinct().withColumn("_blocked", F.lit(True))
    rows = results.join(pending.select(*KEY, F.col("revision").alias("now")), KEY, "left").join(hit, "content_hash", "left")
    outcome = F.when(F.col("cancelled"), "cancelled").when(~F.col("revision").eqNullSafe(F.col("now")), "stale").when(F.col("_blocked"), "blocked").otherwise("written")
    return rows.select(*KEY, outcome.alias("outcome"))


def retried(pending: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """The queue after failures: one attempt more and a pause."""
    marks = failed.select(*KEY).distinct().withColumn("_failed", F.lit(True))
    rows = pending.join(marks, KEY, "left")
    again = F.col("_failed").isNotNull()
    return rows.select(*KEY, F.when(again, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), F.when(again, F.lit(now + RETRY_MS)).otherwise(F.col("retry_after")).alias("retry_after"))


def ready(assets: DataFrame, pending: DataFrame, sources: DataFrame) -> DataFrame:
    """Assets of sources that this library holds itself, and that do not wait for ingest."""
    return assets.join(sources.where("kind = 'federated'").select("source_id"), "source_id", "left_anti").join(pending, KEY, "left_anti")


def due(assets: DataFrame, pending: DataFrame, sources: DataFrame, version: int = PIPELINE_VERSION, force: bool = False) -> DataFrame:
    """Assets to analyse: behind the version, or all if forced."""
    return ready(assets if force else assets.where(F.col("analysis_version") < version), pending, sources)


def derivatives_due(assets: DataFrame, pending: DataFrame, sources: DataFrame, version: int = PIPELINE_VERSION) -> DataFrame:
    """Visual assets whose derivatives are behind the version."""
    return ready(assets.where((F.col("derivative_version") < version) & F.col("media_type").isin(*VISUAL)), pending, sources)


def plan_page(rows: DataFrame, last: tuple[int, str, int] | None = None, limit: int = PLAN_BATCH) -> DataFrame:
    """A batch of due assets in the order of version, source and id."""
    if last is not None:
        key = F.struct(F.col("analysis_version").alias("a"), F.col("source_id").alias("b"), F.col("id").alias("c"))
        rows = rows.where((F.col("analysis_version") >= last[0]) & (key > F.struct(F.lit(last[0]).alias("a"), F.lit(last[1]).alias("b"), F.lit(last[2]).cast("long").alias("c"))))
    return rows.orderBy("analysis_version", "source_id", "id").limit(min(limit, PLAN_BATCH))


def removed(assets: DataFrame, asset: int, every_copy: bool) -> tuple[DataFrame, DataFrame]:
    """The assets without one, or without all that equal it, and the hashes to block."""
    target = assets.where(F.col("id") == asset)
    if not every_copy:
        return assets.where(F.col("id") != asset), target.select("content_hash").where(F.lit(False))
    hashes = target.select("content_hash").where("content_hash IS NOT NULL")
    return assets.where(F.col("id") != asset).join(F.broadcast(hashes), "content_hash", "left_anti"), hashes


def cleared(assets: DataFrame) -> DataFrame:
    """Assets as if never analysed."""
    return assets.withColumns({"analysis_version": F.lit(0), "analysed_at": F.lit(None).cast("long")})


WIPED = ("embedding", "asset_tag", "collection_member", "asset_note", "audio_attr", "image_attr", "model_attr", "video_attr", "document_attr", "asset", "tag", "collection", "source_table", "job", "blocklist")


def wiped(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a catalogue emptied, their columns kept and others untouched, and how many rows of the
    assets, sources, collections and tags went."""
    empty = {name: rows.where(F.lit(False)) if name in WIPED else rows for name, rows in tables.items()}
    counts = [tables[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("asset", "source_table", "collection", "tag") if t in tables]
    return empty, reduce(DataFrame.unionByName, counts)
