"""Counts, roll-ups and duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenshelf.functions.text import nocase
from lumenshelf.operators.filters import Visibility, visible
from lumenshelf.operators.projections import confirmed_tags
from lumenshelf.sources.fixtures import Catalog

MEMBERS_SHOWN, TOP_TAGS = 100, 30
LICENSE_RANKS = {"permissive": 3, "attribution": 2, "unknown": 1, "restricted": 0}


def by_media(assets: DataFrame) -> DataFrame:
    return assets.groupBy("media_type").agg(F.count(F.lit(1)).alias("n"))


def by_source(cat: Catalog, assets: DataFrame) -> DataFrame:
    """Assets per source, sources without any included. The id keeps sources of one name apart."""
    counts = assets.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return cat.source_table.join(counts, "source_id", "left").select("source_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def top_tags(cat: Catalog, assets: DataFrame, limit: int = TOP_TAGS) -> DataFrame:
    named = confirmed_tags(cat).withColumnRenamed("asset_id", "id").join(assets.select("id"), "id", "left_semi")
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def tag_vocabulary(cat: Catalog, prefix: str, limit: int = 50) -> DataFrame:
    """Tags with a prefix: how often confirmed, and whether any use was made by a user."""
    used = cat.asset_tag.where("state = 'confirmed'").groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("source") == "user").alias("manual"))
    named = cat.tag.where(nocase(F.col("name")).startswith(nocase(F.lit(prefix)))).join(used, "tag_id")
    return named.select("name", "n", "manual").orderBy(F.desc("n"), "name").limit(min(max(limit, 1), 50))


def maintained(cat: Catalog, what: str) -> DataFrame:
    """The aggregate tables that keep counts ready, computed whole."""
    missing = F.count_if(F.col("flags").bitwiseAND(1) != 0).alias("missing")
    unanalysed = F.count_if(F.col("analysed_at").isNull()).alias("unanalysed")
    n = F.count(F.lit(1)).alias("n")
    tagged = confirmed_tags(cat).join(cat.asset.select(F.col("id").alias("asset_id"), "source_id"), "asset_id")
    return {
        "library_stat": lambda: cat.asset.agg(n, missing, unanalysed),
        "media_stat": lambda: cat.asset.groupBy("media_type").agg(n, missing, unanalysed),
        "source_stat": lambda: cat.asset.groupBy("source_id").agg(n, missing, unanalysed),
        "source_media_stat": lambda: cat.asset.groupBy("source_id", "media_type").agg(n, missing, unanalysed),
        "tag_stat": lambda: tagged.groupBy("name").agg(n),
        "source_tag_stat": lambda: tagged.groupBy("source_id", "name").agg(n),
    }[what]()


COUNTERS = ("n", "missing", "unanalysed")


def counter_deltas(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What changed rows (before and after, as whole asset rows) add to and take from the counters by ``keys``."""

    def counted(rows: DataFrame, sign: int) -> DataFrame:
        ones = {"n": F.lit(1), "missing": F.col("flags").bitwiseAND(1), "unanalysed": F.col("analysed_at").isNull().cast("int")}
        return rows.select(*keys, *[(c * sign).cast("long").alias(k) for k, c in ones.items()])

    return counted(after, 1).unionByName(counted(before, -1)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def with_deltas(kept: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Kept counters after deltas; counters that reach zero leave. Work in proportion to the changes and the counters."""
    both = kept.select(*keys, *COUNTERS).unionByName(deltas.select(*keys, *COUNTERS)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return both.where("n <> 0")


def drift(kept: DataFrame, assets: DataFrame, keys: list[str]) -> DataFrame:
    """Counters that a recount corrects: keys, the true values, and what is kept now (null if nothing is)."""
    n, missing, unanalysed = F.count(F.lit(1)).alias("n"), F.count_if(F.col("flags").bitwiseAND(1) != 0).alias("missing"), F.count_if(F.col("analysed_at").isNull()).alias("unanalysed")
    true, old = assets.groupBy(*keys).agg(n, missing, unanalysed), kept.select(*keys, *[F.col(c).alias(f"kept_{c}") for c in COUNTERS])
    wrong = [~F.col(c).eqNullSafe(F.col(f"kept_{c}")) for c in COUNTERS]
    return true.join(old, keys, "full").where(wrong[0] | wrong[1] | wrong[2]).select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS], *[f"kept_{c}" for c in COUNTERS])


def child_folders(assets: DataFrame, folder: str) -> DataFrame:
    """Names of the folders directly below one; the bound on the path lets the scan skip the others."""
    below = assets.where((F.col("path") >= folder + "/") & (F.col("path") < folder + "0"))
    rest = F.substring("path", len(folder) + 2, 1 << 30)
    return below.where(F.instr(rest, "/") > 0).select(F.substring_index(rest, "/", 1).alias("name")).distinct()


def total_from_maintained(cat: Catalog, ceiling: Visibility) -> DataFrame:
    """The visible total. Whole sources add up from the kept counts; collections overlap them, so a
    ceiling with collections is counted on the assets."""
    if ceiling.full:
        return maintained(cat, "library_stat").select("n", "unanalysed")
    if ceiling.collections:
        rows = visible(cat, cat.asset, ceiling)
        return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("analysed_at").isNull()).alias("unanalysed"))
    kept = maintained(cat, "source_stat").where(F.col("source_id").isin(sorted(ceiling.sources)) if ceiling.sources else F.lit(False))
    return kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("unanalysed"), F.lit(0)).alias("unanalysed"))


def folder_counts(assets: DataFrame) -> DataFrame:
    """Assets directly in each folder that has any: source_id, folder, direct."""
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    return assets.select("source_id", folder.alias("folder")).groupBy("source_id", "folder").agg(F.count(F.lit(1)).alias("direct"))


def rolled_up(folders: DataFrame) -> DataFrame:
    """Folder counts (source_id, folder, direct) with those of all folders above them: direct and descendant.

    Each folder gives one row per level, whatever its number of assets, so what is shuffled grows with the folders.
    """
    parts = F.split("folder", "/")
    levels = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    above = folders.select("source_id", F.col("folder").alias("of"), "direct", F.explode(levels).alias("folder"))
    return above.groupBy("source_id", "folder").agg(F.sum(F.when(F.col("of") == F.col("folder"), F.col("direct")).otherwise(F.lit(0))).alias("direct"), F.sum("direct").alias("descendant"))


def folder_rollup(assets: DataFrame) -> DataFrame:
    """Assets directly in each folder and anywhere below it; the empty path is the root."""
    return rolled_up(folder_counts(assets))


def folder_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed rows (before and after) add to and take from the roll-up of all folders."""
    change = folder_counts(after).unionByName(folder_counts(before).withColumn("direct", -F.col("direct")))
    return rolled_up(change.groupBy("source_id", "folder").agg(F.sum("direct").alias("direct")).where("direct <> 0"))


def with_folder_deltas(kept: DataFrame, deltas: DataFrame) -> DataFrame:
    """A kept roll-up after deltas; folders with nothing below them leave."""
    both = kept.select("source_id", "folder", "direct", "descendant").unionByName(deltas.select("source_id", "folder", "direct", "descendant"))
    return both.groupBy("source_id", "folder").agg(F.sum("direct").alias("direct"), F.sum("descendant").alias("descendant")).where("descendant <> 0")


def duplicate_groups(assets: DataFrame) -> DataFrame:
    """Content hashes of two assets or more."""
    return assets.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_page(assets: DataFrame, limit: int, last: tuple[int, str] | None = None) -> DataFrame:
    """Groups by size, then hash, behind the last one seen."""
    groups = duplicate_groups(assets)
    if last:
        groups = groups.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("content_hash") > last[1])))
    return groups.orderBy(F.desc("n"), "content_hash").limit(limit)


def duplicate_members(assets: DataFrame, shown: int = MEMBERS_SHOWN) -> DataFrame:
    """The largest members of each group, ranked by size and id."""
    kept = assets.join(duplicate_groups(assets).select("content_hash"), "content_hash", "left_semi")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("content_hash").orderBy(F.coalesce("size_bytes", F.lit(0)).desc(), "id")))
    return ranked.where(F.col("rank") <= shown).select("content_hash", "rank", "id", F.coalesce("size_bytes", F.lit(0)).alias("size"))


def license_rank():
    rank = F.lit(None).cast("int")
    for status, value in LICENSE_RANKS.items():
        rank = F.when(F.col("license_status") == status, F.lit(value)).otherwise(rank)
    return rank


def suggested_keep(assets: DataFrame) -> DataFrame:
    """The member of each group to keep: best licence, then largest, newest, and last by id."""
    best = F.max_by("id", F.struct(license_rank(), F.coalesce("size_bytes", F.lit(0)), F.coalesce("modified_at", F.lit(-(1 << 63))), "id"))
    groups = assets.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), best.alias("keep_id"))
    return groups.where("n > 1").select("content_hash", "n", "keep_id")


def duplicate_membership(assets: DataFrame, ids: list[int]) -> DataFrame:
    """For the asked ids that have copies: how many assets share their content."""
    asked = assets.where(F.col("id").isin(ids)).select("id", "content_hash")
    counts = assets.join(asked.select("content_hash").distinct(), "content_hash", "left_semi").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counts.where("n > 1"), "content_hash").select("id", "n")


def members_page(assets: DataFrame, content_hash: str, limit: int, last: tuple[int, int] | None = None) -> DataFrame:
    size = F.coalesce("size_bytes", F.lit(0))
    rows = assets.where(F.col("content_hash") == content_hash).select("id", size.alias("size"))
    if last:
        rows = rows.where((F.col("size") < last[0]) | ((F.col("size") == last[0]) & (F.col("id") > last[1])))
    return rows.orderBy(F.desc("size"), "id").limit(limit)


def member_counts(cat: Catalog, ceiling: Visibility) -> DataFrame:
    """Visible members of each collection, empty ones included."""
    seen = visible(cat, cat.asset, ceiling).select(F.col("id").alias("asset_id"))
    counts = cat.collection_member.join(seen, "asset_id", "left_semi").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    return cat.collection.join(counts, "collection_id", "left").select("collection_id", F.coalesce("n", F.lit(0)).alias("n"))


def tag_text(cat: Catalog) -> DataFrame:
    """All confirmed tags of an asset as one searchable string."""
    return confirmed_tags(cat).groupBy("asset_id").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("tags"))
