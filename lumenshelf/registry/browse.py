"""Queries on scans, projections, filters, joins, aggregates, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenshelf.operators import aggregates, projections
from lumenshelf.operators.filters import FIELDS, Filter, Visibility, apply_filters, not_blocked, not_pending, visible
from lumenshelf.plans.browse import QueryRequest, after, browse_size, order, page, total
from lumenshelf.registry import query
from lumenshelf.sources.fixtures import Catalog
from lumenshelf.streaming import counters

SIZE = "size_bytes + coalesce(dependency_bytes, 0)"
CONFIRMED = "SELECT x.asset_id FROM asset_tag x JOIN tag t ON t.tag_id = x.tag_id WHERE x.state = 'confirmed'"
HALF = Visibility.only(sources=["src1", "src2"], collections=[3])


def ids(rows: DataFrame) -> DataFrame:
    return rows.select("id")


query("scan_table", "SELECT id, filename, source_id FROM asset")(lambda c: c.asset.select("id", "filename", "source_id"))
query("topk_page", f"SELECT id, filename, {SIZE} AS browse_size FROM asset WHERE media_type = 'document' AND size_bytes > 500 ORDER BY filename ASC NULLS FIRST, id LIMIT 51")(
    lambda c: page(c, QueryRequest(filters=[Filter("media_type", "eq", "document"), Filter("size_bytes", "gt", 500)], limit=50)).select("id", "filename", "browse_size")
)
query("grid_pending", "SELECT id, EXISTS (SELECT 1 FROM pending_ingest p WHERE p.source_id = asset.source_id AND p.path = asset.path) AS ingest_pending FROM asset")(lambda c: projections.pending_flag(c, c.asset))
query("browse_size", f"SELECT id, {SIZE} AS browse_size FROM asset")(lambda c: c.asset.select("id", browse_size()))
JOINED = """asset a LEFT JOIN image_attr i ON i.asset_id = a.id LEFT JOIN audio_attr u ON u.asset_id = a.id LEFT JOIN model_attr m ON m.asset_id = a.id
 LEFT JOIN video_attr v ON v.asset_id = a.id LEFT JOIN document_attr d ON d.asset_id = a.id"""
query(
    "grid_select",
    f"""SELECT a.id, a.filename, a.media_type, a.format, a.size_bytes + coalesce(a.dependency_bytes, 0) AS browse_size, a.source_id, a.license_status, (a.flags & 1) <> 0 AS missing, (a.flags & 2) <> 0 AS favorite,
 coalesce(i.width, v.width) AS width, coalesce(i.height, v.height) AS height, coalesce(u.duration_ms, v.duration_ms) AS duration_ms, m.triangle_count AS model_triangle_count, d.page_count AS document_page_count, d.word_count AS document_word_count, a.scanned_at FROM {JOINED}""",
)(lambda c: projections.grid(c, c.asset))


@query(
    "grid_key_attrs",
    f"""SELECT a.id, CASE WHEN a.media_type IN ('image', 'video') THEN concat(coalesce(i.width, v.width), '×', coalesce(i.height, v.height)) END AS dimensions,
 CASE WHEN a.media_type IN ('audio', 'video') THEN concat(coalesce(u.duration_ms, v.duration_ms) // 60000, ':', lpad(CAST(coalesce(u.duration_ms, v.duration_ms) // 1000 % 60 AS VARCHAR), 2, '0')) END AS duration,
 CAST(m.triangle_count AS VARCHAR) AS tris, CASE WHEN d.page_count > 0 THEN CAST(d.page_count AS VARCHAR) END AS pages, CASE WHEN d.word_count > 0 THEN CAST(d.word_count AS VARCHAR) END AS words FROM {JOINED}""",
)
def grid_key_attrs(c: Catalog) -> DataFrame:
    rows = projections.with_attributes(c, c.asset).withColumns(projections.shared_attributes())
    rows = rows.select("id", projections.key_attributes().alias("facts"))
    return rows.select("id", *[F.col("facts")[k].alias(k) for k in ("dimensions", "duration", "tris", "pages", "words")])


query(
    "asset_detail",
    """SELECT a.id, a.filename, a.license_status, t.tags, k.collections, n.body AS note FROM asset a
 LEFT JOIN (SELECT x.asset_id, string_agg(x.state || ':' || t.name, ',' ORDER BY x.state, t.name) AS tags FROM asset_tag x JOIN tag t USING (tag_id) GROUP BY 1) t ON t.asset_id = a.id
 LEFT JOIN (SELECT m.asset_id, string_agg(c.name, ',' ORDER BY c.name) AS collections FROM collection_member m JOIN collection c USING (collection_id) GROUP BY 1) k ON k.asset_id = a.id
 LEFT JOIN asset_note n ON n.asset_id = a.id""",
)(lambda c: projections.detail(c, c.asset))
MANIFEST = """SELECT a.id, filename, path, media_type, format, size_bytes, content_hash, source_id, license_id, license_status, commercial, modify, redistribute, attribution, holder, credit, t.tags, n.body AS note
 FROM asset a LEFT JOIN (SELECT x.asset_id, string_agg(t.name, ';' ORDER BY t.name) AS tags FROM asset_tag x JOIN tag t USING (tag_id) WHERE x.state = 'confirmed' GROUP BY 1) t ON t.asset_id = a.id LEFT JOIN asset_note n ON n.asset_id = a.id"""
query("export_rows", MANIFEST)(lambda c: projections.manifest(c, c.asset))
query("manifest_row", MANIFEST)(lambda c: projections.manifest(c, c.asset))
CREDITS = "SELECT id, filename, license_id, holder, credit FROM asset WHERE coalesce(attribution, FALSE) OR license_status = 'attribution' OR holder IS NOT NULL OR credit IS NOT NULL"
query("export_attribution_only", CREDITS)(lambda c: projections.credits(c.asset))
query("credit_row", f"SELECT * FROM ({CREDITS}) WHERE holder IS NOT NULL")(lambda c: projections.credits(c.asset).where("holder IS NOT NULL"))
query("redact_source", "SELECT source_id, name, kind, '<redacted>' AS connection FROM source_table")(lambda c: projections.redacted(c.source_table))

# One query per filter rule, then one per field.


def filtered(name: str, filters: list[Filter], where: str) -> None:
    query(name, f"SELECT id FROM asset WHERE {where}")(lambda c: ids(apply_filters(c, c.asset, filters)))


filtered("f_eq_or_in", [Filter("media_type", "in", ["image", "document"]), Filter("format", "eq", "txt"), Filter("license", "in", ["unknown", "permissive"])], "media_type IN ('image', 'document') AND format = 'txt' AND license_status IN ('unknown', 'permissive')")
filtered("f_source", [Filter("source", "eq", "src3")], "source_id = 'src3'")
filtered("f_size", [Filter("size_bytes", "gte", 1000.9), Filter("size_bytes", "range", (0, 20000))], "size_bytes >= 1000 AND size_bytes BETWEEN 0 AND 20000")
filtered("f_usage_right", [Filter("commercial", "eq", True), Filter("modify", "ne", True)], "commercial = TRUE AND modify = FALSE")
filtered("f_tag", [Filter("tag", "in", ["TEXTURE", "nation_9"])], f"id IN ({CONFIRMED} AND lower(t.name) IN ('texture', 'nation_9'))")
filtered("f_attr_num", [Filter("sample_rate", "eq", 48000), Filter("bpm", "range", (80, 140))], "id IN (SELECT asset_id FROM audio_attr WHERE sample_rate = 48000 AND bpm BETWEEN 80 AND 140)")
filtered("f_attr_num_union", [Filter("width", "gt", 1000)], "id IN (SELECT asset_id FROM image_attr WHERE width > 1000 UNION ALL SELECT asset_id FROM video_attr WHERE width > 1000)")
filtered("f_attr_str", [Filter("color_space", "in", ["SRGB", "p3"])], "id IN (SELECT asset_id FROM image_attr WHERE lower(color_space) IN ('srgb', 'p3'))")
filtered("f_attr_bool", [Filter("has_rig", "eq", False)], "id IN (SELECT asset_id FROM model_attr WHERE has_rig = FALSE)")
filtered("f_reviewed_class", [Filter("image_class", "eq", "Texture")], f"id IN ({CONFIRMED} AND lower(t.name) = 'texture') AND id IN (SELECT asset_id FROM image_attr)")
filtered("f_favorite", [Filter("favorite", "eq", True)], "(flags & 2) <> 0")
filtered("f_path", [Filter("path", "eq", "EN/src1")], "starts_with(lower(path), 'en/src1')")
filtered("f_folder", [Filter("folder", "eq", "en/src1/")], "starts_with(lower(path), 'en/src1/') AND NOT contains(substr(path, 9), '/')")
query("f_visibility", "SELECT id FROM asset WHERE source_id IN ('src1', 'src2') OR id IN (SELECT asset_id FROM collection_member WHERE collection_id = 3)")(lambda c: ids(visible(c, c.asset, HALF)))
query("f_write_view", "SELECT id FROM asset WHERE (source_id IN ('src1', 'src2') OR id IN (SELECT asset_id FROM collection_member WHERE collection_id = 3)) AND source_id = 'src2'")(lambda c: ids(visible(c, visible(c, c.asset, HALF), Visibility.only(sources=["src2"]))))
query("f_blocklist", "SELECT id FROM asset WHERE content_hash NOT IN (SELECT content_hash FROM blocklist)")(lambda c: ids(not_blocked(c, c.asset)))
query("f_not_pending", "SELECT id FROM asset WHERE NOT EXISTS (SELECT 1 FROM pending_ingest p WHERE p.source_id = asset.source_id AND p.path = asset.path)")(lambda c: ids(not_pending(c, c.asset)))
query("f_keyset", "SELECT id FROM asset WHERE (filename, id) > ('m', 5)")(lambda c: ids(c.asset.where(after("filename", False, "m", 5))))

NUMERIC = {"width": 1000, "height": 900, "duration": 20000, "color_depth": 16, "tileability": 0.5, "bpm": 100, "sample_rate": 44100, "bit_depth": 16, "channels": 2, "loudness": -20, "brightness": 0.4, "harmonicity": 0.3, "tri_count": 9000, "vertex_count": 9000, "mesh_count": 3, "material_count": 4, "texture_count": 2, "dependency_bytes": 2000, "fps": 30, "bitrate": 2000000, "page_count": 2, "word_count": 300}
TEXT = {"color_space": "linear", "tile_class": "seamless", "musical_key": "AM", "codec": "pcm", "container": "riff", "author": "author 3"}


def by_field(name: str) -> tuple[Filter, str] | None:
    """A representative filter on a field, and the same in SQL."""
    from lumenshelf.operators.filters import BOOLEANS, CLASSES, NUMBERS, STRINGS

    if name in NUMERIC:
        tables, column = NUMBERS[name]
        return Filter(name, "gte", NUMERIC[name]), "id IN (" + " UNION ALL ".join(f"SELECT asset_id FROM {t} WHERE {column} >= {NUMERIC[name]}" for t in tables) + ")"
    if name in TEXT:
        table, column = STRINGS[name]
        return Filter(name, "eq", TEXT[name]), f"id IN (SELECT asset_id FROM {table} WHERE lower({column}) = lower('{TEXT[name]}'))"
    if name in BOOLEANS:
        table, column = BOOLEANS[name]
        return Filter(name, "eq", True), f"id IN (SELECT asset_id FROM {table} WHERE {column} = TRUE)"
    if name in CLASSES:
        tag = {"image_class": "sprite", "audio_class": "music", "model_class": "prop", "video_class": "clip", "document_class": "document"}[name]
        return Filter(name, "in", [tag.upper()]), f"id IN ({CONFIRMED} AND lower(t.name) = '{tag}') AND id IN (SELECT asset_id FROM {CLASSES[name]})"
    return None


for _field in FIELDS:
    if (_pair := by_field(_field)) is not None:
        filtered(f"field_{_field}", [_pair[0]], _pair[1])
for _right in ("redistribute", "attribution"):
    filtered(f"field_{_right}", [Filter(_right, "ne", False)], f"{_right} = TRUE")

# Joins

query("join_attr_left5", f"SELECT a.id, i.width AS image_width, u.bpm AS audio_bpm, m.mesh_count AS model_mesh_count, v.fps AS video_fps, d.word_count AS document_word_count FROM {JOINED}")(
    lambda c: projections.with_attributes(c, c.asset).select("id", "image_width", "audio_bpm", "model_mesh_count", "video_fps", "document_word_count")
)
query("join_semi_subquery", f"SELECT id FROM asset WHERE id IN ({CONFIRMED})")(lambda c: ids(c.asset.join(c.asset_tag.where("state = 'confirmed'").select(F.col("asset_id").alias("id")), "id", "left_semi")))
query("join_anti_cte", "SELECT a.id FROM asset a LEFT JOIN asset_note n ON n.asset_id = a.id WHERE n.asset_id IS NULL")(lambda c: ids(c.asset.join(c.asset_note.withColumnRenamed("asset_id", "id"), "id", "left_anti")))
query("join_not_exists", "SELECT id FROM asset WHERE NOT EXISTS (SELECT 1 FROM collection_member m WHERE m.asset_id = asset.id)")(lambda c: ids(c.asset.join(c.collection_member.select(F.col("asset_id").alias("id")), "id", "left_anti")))
query("join_many_many_tags", "SELECT a.id, t.name, x.state FROM asset a JOIN asset_tag x ON x.asset_id = a.id JOIN tag t ON t.tag_id = x.tag_id")(
    lambda c: c.asset.select("id").join(c.asset_tag.withColumnRenamed("asset_id", "id"), "id").join(c.tag, "tag_id").select("id", "name", "state")
)
query("join_outer_count", "SELECT s.source_id, s.name, count(a.id) AS n FROM source_table s LEFT JOIN asset a ON a.source_id = s.source_id GROUP BY 1, 2")(lambda c: aggregates.by_source(c, c.asset))


def in_order(c: Catalog, wanted: list[int]) -> DataFrame:
    """Assets in the caller's order, repeats kept."""
    listed = c.spark.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in wanted])).alias("position", "id"))
    return F.broadcast(listed).join(c.asset, "id").select("position", "id", "filename").orderBy("position")


WANTED = [8, 3, 8, 101, 4, 999999, 77]
POSITIONS = f"SELECT CAST(w.position AS INT) AS position, a.id, a.filename FROM (SELECT unnest(range(7)) AS position, unnest({WANTED}) AS id) w JOIN asset a ON a.id = w.id"
query("join_values_position", POSITIONS)(lambda c: in_order(c, WANTED))
query("export_select_assets", POSITIONS)(lambda c: in_order(c, WANTED))
query("export_select_collection", "SELECT a.id, a.filename, m.added_at FROM asset a JOIN collection_member m ON m.asset_id = a.id WHERE m.collection_id = 2")(
    lambda c: c.collection_member.where("collection_id = 2").withColumnRenamed("asset_id", "id").join(c.asset, "id").select("id", "filename", "added_at").orderBy(F.desc("added_at"), "id")
)
query("export_select_query", "SELECT id, filename FROM asset WHERE media_type = 'video'")(lambda c: apply_filters(c, c.asset, [Filter("media_type", "eq", "video")]).select("id", "filename").orderBy("filename", "id"))
query("join_prefix_range", "SELECT id FROM asset WHERE path = 'en/src1' OR (path >= 'en/src1/' AND path < 'en/src10')")(lambda c: ids(c.asset.where((F.col("path") == "en/src1") | ((F.col("path") >= "en/src1/") & (F.col("path") < "en/src10")))))

# Aggregates

query("agg_total", "SELECT count(*) AS total FROM asset WHERE media_type = 'document' AND (flags & 2) <> 0")(lambda c: total(c, QueryRequest(filters=[Filter("media_type", "eq", "document"), Filter("favorite", "eq", True)])))
query("agg_by_media", "SELECT media_type, count(*) AS n FROM asset GROUP BY 1")(lambda c: aggregates.by_media(c.asset))
query("agg_by_source", "SELECT s.source_id, s.name, count(a.id) AS n FROM source_table s LEFT JOIN asset a ON a.source_id = s.source_id GROUP BY 1, 2")(lambda c: aggregates.by_source(c, c.asset))
query("agg_top_tags", "SELECT t.name, count(*) AS n FROM asset_tag x JOIN tag t USING (tag_id) WHERE x.state = 'confirmed' GROUP BY 1 ORDER BY n DESC, name LIMIT 30")(lambda c: aggregates.top_tags(c, c.asset))
query("agg_unanalyzed", "SELECT count(*) FILTER (WHERE analysed_at IS NULL) AS n FROM asset")(lambda c: c.asset.agg(F.count_if(F.col("analysed_at").isNull()).alias("n")))
query("agg_sources_visible", "SELECT count(*) AS n FROM source_table WHERE source_id IN ('src1', 'src2')")(lambda c: c.source_table.where(F.col("source_id").isin(sorted(HALF.sources))).agg(F.count(F.lit(1)).alias("n")))
query("agg_stats_maintained", "SELECT count(*) AS n, count(*) FILTER (WHERE analysed_at IS NULL) AS unanalysed FROM asset WHERE source_id IN ('src4', 'src5')")(lambda c: counters.kept_counters(c).total(c, Visibility.only(sources=["src4", "src5"])))
query("agg_stats_collections", "SELECT count(*) AS n, count(*) FILTER (WHERE analysed_at IS NULL) AS unanalysed FROM asset WHERE source_id IN ('src1', 'src2') OR id IN (SELECT asset_id FROM collection_member WHERE collection_id = 3)")(lambda c: aggregates.total_from_maintained(c, HALF))
STAT = "count(*) AS n, count(*) FILTER (WHERE (flags & 1) <> 0) AS missing, count(*) FILTER (WHERE analysed_at IS NULL) AS unanalysed FROM asset"
query("agg_maintained_build", f"SELECT source_id, media_type, {STAT} GROUP BY 1, 2")(lambda c: aggregates.maintained(c, "source_media_stat"))
query("agg_library_stat", f"SELECT {STAT}")(lambda c: aggregates.maintained(c, "library_stat"))
query("agg_media_stat", f"SELECT media_type, {STAT} GROUP BY 1")(lambda c: aggregates.maintained(c, "media_stat"))
query("agg_source_stat", f"SELECT source_id, {STAT} GROUP BY 1")(lambda c: aggregates.maintained(c, "source_stat"))
query("agg_tag_stat", "SELECT t.name, count(*) AS n FROM asset_tag x JOIN tag t USING (tag_id) WHERE state = 'confirmed' GROUP BY 1")(lambda c: aggregates.maintained(c, "tag_stat"))
query("agg_source_tag_stat", "SELECT a.source_id, t.name, count(*) AS n FROM asset_tag x JOIN tag t USING (tag_id) JOIN asset a ON a.id = x.asset_id WHERE state = 'confirmed' GROUP BY 1, 2")(lambda c: aggregates.maintained(c, "source_tag_stat"))
query("agg_tag_vocab", "SELECT t.name, count(*) AS n, bool_or(x.source = 'user') AS manual FROM asset_tag x JOIN tag t USING (tag_id) WHERE state = 'confirmed' AND starts_with(lower(t.name), 'nation_1') GROUP BY 1 ORDER BY n DESC, name LIMIT 50")(lambda c: aggregates.tag_vocabulary(c, "NATION_1"))
DUPS = "SELECT content_hash, count(*) AS n FROM asset GROUP BY 1 HAVING count(*) > 1"
query("agg_dup_groups", DUPS)(lambda c: aggregates.duplicate_groups(c.asset))
query("agg_dup_membership", f"SELECT a.id, d.n FROM asset a JOIN ({DUPS}) d USING (content_hash) WHERE a.id IN (1, 2, 3, 4, 5, 6, 7, 8, 200)")(lambda c: aggregates.duplicate_membership(c.asset, [1, 2, 3, 4, 5, 6, 7, 8, 200]))
query(
    "agg_folder_rollup",
    """SELECT source_id, folder, count(*) FILTER (WHERE lvl = depth) AS direct, count(*) AS descendant FROM
 (SELECT source_id, depth, lvl, array_to_string(parts[1:lvl], '/') AS folder FROM (SELECT source_id, string_split(path, '/') AS parts, len(string_split(path, '/')) - 1 AS depth, unnest(range(len(string_split(path, '/')))) AS lvl FROM asset)) GROUP BY 1, 2""",
)(lambda c: aggregates.folder_rollup(c.asset))
query("agg_concat_tags", "SELECT x.asset_id, string_agg(t.name, ' ' ORDER BY t.name) AS tags FROM asset_tag x JOIN tag t USING (tag_id) WHERE x.state = 'confirmed' GROUP BY 1")(lambda c: aggregates.tag_text(c))
query("agg_distinct_sources", "SELECT DISTINCT source_id FROM asset WHERE analysis_version < 2")(lambda c: c.asset.where("analysis_version < 2").select("source_id").distinct())
query("agg_member_count", "SELECT c.collection_id, count(a.id) AS n FROM collection c LEFT JOIN collection_member m USING (collection_id) LEFT JOIN (SELECT id FROM asset WHERE source_id IN ('src1', 'src2') OR id IN (SELECT asset_id FROM collection_member WHERE collection_id = 3)) a ON a.id = m.asset_id GROUP BY 1")(lambda c: aggregates.member_counts(c, HALF))

# Windows, order and pages

query("win_dup_members", f"SELECT content_hash, CAST(rank AS INT) AS rank, id, size FROM (SELECT content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY coalesce(size_bytes, 0) DESC, id) AS rank, id, coalesce(size_bytes, 0) AS size FROM asset WHERE content_hash IN (SELECT content_hash FROM ({DUPS}))) WHERE rank <= 100")(lambda c: aggregates.duplicate_members(c.asset))
query("win_suggested_keep", "SELECT content_hash, count(*) AS n, arg_max(id, (CASE license_status WHEN 'permissive' THEN 3 WHEN 'attribution' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END, coalesce(size_bytes, 0), coalesce(modified_at, -9223372036854775808), id)) AS keep_id FROM asset GROUP BY 1 HAVING count(*) > 1")(lambda c: aggregates.suggested_keep(c.asset))
for _sort, _key, _null in (("name", "filename", ""), ("size", "browse_size", ""), ("scanned", "scanned_at", "")):
    for _desc in (False, True):
        query(
            f"sort_{_sort}" + "_desc" * _desc,
            f"SELECT id, {_key} AS key FROM (SELECT *, {SIZE} AS browse_size FROM asset) ORDER BY {_key} {'DESC NULLS LAST, id DESC' if _desc else 'ASC NULLS FIRST, id'} LIMIT 101",
        )(lambda c, s=_sort, k=_key, d=_desc: page(c, QueryRequest(sort=s, descending=d)).select("id", F.col(k).alias("key")))
query("sort_relevance_no_text", "SELECT id, filename FROM asset ORDER BY filename, id LIMIT 101")(lambda c: page(c, QueryRequest()).select("id", "filename"))
SIZED = f"(SELECT id, {SIZE} AS browse_size FROM asset) s"
query("keyset_null", f"SELECT id, browse_size FROM {SIZED} WHERE browse_size IS NOT NULL OR id > 300 ORDER BY browse_size ASC NULLS FIRST, id LIMIT 200")(
    lambda c: c.asset.select("id", browse_size()).where(after("browse_size", False, None, 300)).orderBy(*order("browse_size", False)).limit(200)
)
query("keyset_null_desc", f"SELECT id, browse_size FROM {SIZED} WHERE browse_size IS NULL OR browse_size < 3000 OR (browse_size = 3000 AND id < 77) ORDER BY browse_size DESC NULLS LAST, id DESC LIMIT 200")(
    lambda c: c.asset.select("id", browse_size()).where(after("browse_size", True, 3000, 77)).orderBy(*order("browse_size", True)).limit(200)
)
query("page_dup_exact", f"SELECT content_hash, n FROM ({DUPS}) WHERE n < 20 OR (n = 20 AND content_hash > '5') ORDER BY n DESC, content_hash LIMIT 25")(lambda c: aggregates.duplicate_page(c.asset, 25, (20, "5")))


@query("page_dup_members", f"SELECT id, coalesce(size_bytes, 0) AS size FROM asset WHERE content_hash = (SELECT content_hash FROM ({DUPS}) ORDER BY n DESC, content_hash LIMIT 1) AND (coalesce(size_bytes, 0) < 30000 OR (coalesce(size_bytes, 0) = 30000 AND id > 5)) ORDER BY size DESC, id LIMIT 10")
def page_dup_members(c: Catalog) -> DataFrame:
    first = aggregates.duplicate_page(c.asset, 1).first()
    return aggregates.members_page(c.asset, first["content_hash"] if first else "", 10, (30000, 5))


# Sets

query("set_union_distinct", "SELECT id FROM asset WHERE filename LIKE '%ring%' UNION SELECT id FROM asset WHERE path LIKE 'PROMO%'")(lambda c: ids(c.asset.where(F.col("filename").contains("ring"))).union(ids(c.asset.where(F.col("path").startswith("PROMO")))).distinct())
query("set_union_all", "SELECT asset_id, width FROM image_attr UNION ALL SELECT asset_id, width FROM video_attr")(lambda c: c.image_attr.select("asset_id", "width").unionByName(c.video_attr.select("asset_id", "width")))
filtered("set_intersect", [Filter("tag", "eq", "texture"), Filter("width", "gt", 500), Filter("favorite", "eq", True)], f"id IN ({CONFIRMED} AND lower(t.name) = 'texture') AND id IN (SELECT asset_id FROM image_attr WHERE width > 500 UNION ALL SELECT asset_id FROM video_attr WHERE width > 500) AND (flags & 2) <> 0")
query("set_except", "SELECT source_id, path FROM asset EXCEPT SELECT source_id, path FROM pending_ingest")(lambda c: c.asset.select("source_id", "path").join(c.pending_ingest, ["source_id", "path"], "left_anti").distinct())
query("set_visibility_union", "SELECT count(*) AS n FROM asset WHERE source_id IN ('src1', 'src2') OR id IN (SELECT asset_id FROM collection_member WHERE collection_id = 3)")(lambda c: visible(c, c.asset, HALF).agg(F.count(F.lit(1)).alias("n")))
