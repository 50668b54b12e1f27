"""Projections of assets: grid rows, details, manifests, credits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenshelf.plans.browse import browse_size
from lumenshelf.sources.fixtures import Catalog

ATTRIBUTE_TABLES = ("image_attr", "audio_attr", "model_attr", "video_attr", "document_attr")
MEDIA = ("image", "audio", "model", "video", "document")


def with_attributes(cat: Catalog, assets: DataFrame, tables: tuple[str, ...] = ATTRIBUTE_TABLES) -> DataFrame:
    """Assets with the columns of the attribute tables, each under its table's short name.

    An asset has a row in at most one of the tables, so the left joins never multiply rows.
    """

    def add(rows: DataFrame, table: str) -> DataFrame:
        short = table.removesuffix("_attr")
        attrs = getattr(cat, table)
        named = attrs.select(F.col("asset_id").alias("id"), *[F.col(c).alias(f"{short}_{c}") for c in attrs.columns if c != "asset_id"])
        return rows.join(named, "id", "left")

    return reduce(add, tables, assets)


def minutes(milliseconds: Column) -> Column:
    """m:ss"""
    seconds = milliseconds / 1000.0
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), (seconds % 60).cast("long"))


def shared_attributes() -> dict[str, Column]:
    """The attributes that two tables share; at most one of them has a value."""
    return {"width": F.coalesce("image_width", "video_width"), "height": F.coalesce("image_height", "video_height"), "duration_ms": F.coalesce("audio_duration_ms", "video_duration_ms")}


def key_attributes() -> Column:
    """The few facts on a tile, by media type, as a map without nulls."""
    m = lambda *kinds: F.col("media_type").isin(*kinds)
    sized = F.when(m("image", "video"), F.concat(F.col("width").cast("string"), F.lit("×"), F.col("height").cast("string")))
    positive = lambda c: F.when(m("document") & (F.col(c) > 0), F.col(c).cast("string"))
    entries = F.create_map(
        F.lit("dimensions"), sized, F.lit("duration"), F.when(m("audio", "video"), minutes(F.col("duration_ms"))),
        F.lit("tris"), F.when(m("model"), F.col("model_triangle_count").cast("string")), F.lit("pages"), positive("document_page_count"), F.lit("words"), positive("document_word_count"),
    )
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def grid(cat: Catalog, assets: DataFrame) -> DataFrame:
    """The summary of each asset: sixteen columns over the exclusive attribute joins."""
    rows = with_attributes(cat, assets)
    return rows.select(
        "id", "filename", "media_type", "format", browse_size(), "source_id", "license_status", (F.col("flags").bitwiseAND(1) != 0).alias("missing"), (F.col("flags").bitwiseAND(2) != 0).alias("favorite"),
        *[c.alias(n) for n, c in shared_attributes().items()], "model_triangle_count", "document_page_count", "document_word_count", "scanned_at",
    )


def pending_flag(cat: Catalog, assets: DataFrame) -> DataFrame:
    """id and whether the asset waits for ingest."""
    waiting = cat.pending_ingest.select("source_id", "path").distinct().withColumn("_waits", F.lit(True))
    return assets.join(waiting, ["source_id", "path"], "left").select("id", F.col("_waits").isNotNull().alias("ingest_pending"))


def detail(cat: Catalog, assets: DataFrame) -> DataFrame:
    """Assets with tags ordered by state and name, collections by name, and the note."""
    tags = cat.asset_tag.join(cat.tag, "tag_id").groupBy("asset_id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("state", "name"))), lambda s: F.concat(s["state"], F.lit(":"), s["name"]))).alias("tags"))
    held = cat.collection_member.join(cat.collection, "collection_id").groupBy("asset_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("name"))).alias("collections"))
    notes = cat.asset_note.withColumnRenamed("body", "note")
    out = assets
    for side in (tags, held, notes):
        out = out.join(side.withColumnRenamed("asset_id", "id"), "id", "left")
    return out.select("id", "filename", "license_status", "tags", "collections", "note")


def confirmed_tags(cat: Catalog) -> DataFrame:
    """asset_id, name of confirmed tags."""
    return cat.asset_tag.where("state = 'confirmed'").join(cat.tag, "tag_id").select("asset_id", "name")


def manifest(cat: Catalog, assets: DataFrame) -> DataFrame:
    """Export rows: asset columns, confirmed tags by name, note."""
    tags = confirmed_tags(cat).groupBy("asset_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ";").alias("tags"))
    rows = assets.join(tags.withColumnRenamed("asset_id", "id"), "id", "left").join(cat.asset_note.selectExpr("asset_id AS id", "body AS note"), "id", "left")
    return rows.select("id", "filename", "path", "media_type", "format", "size_bytes", "content_hash", "source_id", "license_id", "license_status", "commercial", "modify", "redistribute", "attribution", "holder", "credit", "tags", "note")


def needs_attribution() -> Column:
    return F.coalesce(F.col("attribution"), F.lit(False)) | (F.col("license_status") == "attribution") | F.col("holder").isNotNull() | F.col("credit").isNotNull()


def credits(assets: DataFrame) -> DataFrame:
    return assets.where(needs_attribution()).select("id", "filename", "license_id", "holder", "credit")


def redacted(sources: DataFrame) -> DataFrame:
    """Sources without what their connection keeps secret."""
    return sources.select("source_id", "name", "kind", F.when(F.col("connection").isNotNull(), F.lit("<redacted>")).alias("connection"))
