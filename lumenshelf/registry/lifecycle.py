"""Queries on ingest, review, export, federation, feature extraction and the change feed."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.storage import shared_folder
from lumenshelf.operators import aggregates, documents, exchange, features, ingest, media, projections, review
from lumenshelf.operators.filters import Visibility, visible
from lumenshelf.plans.browse import smart_members
from lumenshelf.registry import query
from lumenshelf.registry.search import sql_spaces, spaces
from lumenshelf.sources.fixtures import Catalog
from lumenshelf.streaming import counters, events


def n():
    """A count of rows; made when asked for, since columns need a session."""
    return F.count(F.lit(1)).alias("n")


def listing(c: Catalog) -> DataFrame:
    """A later scan: some files changed content, some changed type, some are new, some are gone."""
    a = c.asset
    seen = a.where("id % 5 <> 0").select("source_id", "path", F.when(F.expr("id % 7 = 0"), F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash")).alias("content_hash"), "filename", "size_bytes", "modified_at", F.lit(1800000000000).alias("scanned_at"), F.when(F.expr("id % 11 = 0"), "audio").otherwise(F.col("media_type")).alias("media_type"), "format")
    new = a.where("id % 20 = 1").select("source_id", F.concat(F.lit("new/"), "path").alias("path"), "content_hash", "filename", "size_bytes", "modified_at", F.lit(1800000000000).alias("scanned_at"), "media_type", "format")
    return seen.unionByName(new)


AFTER = """(SELECT id, source_id, path, CASE WHEN remade THEN 0 ELSE version END AS analysis_version, CASE WHEN remade THEN 0 ELSE drawn END AS derivative_version, CASE WHEN remade THEN NULL ELSE analysed END AS analysed_at, flags, CASE WHEN is_new THEN 'new' WHEN remade THEN 'remade' WHEN seen THEN 'seen' ELSE 'kept' END AS outcome, re AS reclassified FROM
 (SELECT id, source_id, path, FALSE AS is_new, id % 5 <> 0 AS seen, id % 5 <> 0 AND (id % 7 = 0 OR (id % 11 = 0 AND media_type <> 'audio')) AS remade, id % 5 <> 0 AND id % 11 = 0 AND media_type <> 'audio' AS re, analysis_version AS version, derivative_version AS drawn, analysed_at AS analysed, CASE WHEN id % 5 <> 0 THEN flags & -2 ELSE flags END AS flags FROM asset
 UNION ALL SELECT (SELECT max(id) FROM asset) + row_number() OVER (ORDER BY md5(concat(source_id, '/', 'new/', path)), source_id, path), source_id, concat('new/', path), TRUE, TRUE, FALSE, FALSE, 0, 0, NULL, 0 FROM asset WHERE id % 20 = 1))"""
query("upsert_asset", f"SELECT * FROM {AFTER}")(lambda c: ingest.upsert(c.asset, listing(c).unionByName(listing(c)), 1800000000000).select("id", "source_id", "path", "analysis_version", "derivative_version", "analysed_at", "flags", "outcome", "reclassified"))
query("upsert_attributes", f"SELECT asset_id, width FROM image_attr WHERE asset_id NOT IN (SELECT id FROM {AFTER} WHERE reclassified)")(lambda c: ingest.derived_kept(c.image_attr.select("asset_id", "width"), ingest.upsert(c.asset, listing(c), 1800000000000), "image"))


OBSERVED = "id % 4 <> 1"
query("scan_begin", "SELECT source_id, CAST(count(*) % 7 + CASE WHEN source_id = 'src2' THEN 1 ELSE 0 END AS INT) AS generation FROM asset GROUP BY 1")(lambda c: ingest.begun(c.asset.groupBy("source_id").agg((F.count(F.lit(1)) % 7).cast("int").alias("generation")), "src2"))
query("scan_observe", f"SELECT id, (flags & -2) AS flags FROM asset WHERE {OBSERVED}")(lambda c: ingest.observe(c.asset, c.asset.where(OBSERVED)))
query("scan_finish", f"SELECT id, CASE WHEN source_id = 'src2' AND NOT ({OBSERVED}) THEN flags | 1 ELSE flags END AS flags FROM asset")(lambda c: ingest.mark_missing(c.asset, c.asset.where(OBSERVED), "src2", 7, 7))
query("scan_finish_scoped", f"SELECT id, CASE WHEN source_id = 'src2' AND NOT ({OBSERVED}) AND starts_with(path, 'en/') THEN flags | 1 ELSE flags END AS flags FROM asset")(lambda c: ingest.mark_missing(c.asset, c.asset.where(OBSERVED), "src2", 7, 7, ["en"]))
query("scan_finish_overtaken", "SELECT id, flags FROM asset")(lambda c: ingest.mark_missing(c.asset, c.asset.where(OBSERVED), "src2", 6, 7))
query("delta_token", "SELECT id, modified_at IS NOT NULL AND id % 3 <> 0 AS unchanged FROM asset")(
    lambda c: c.asset.select("id", F.col("size_bytes").alias("size"), F.col("modified_at").alias("mtime"), F.col("size_bytes").alias("seen_size"), F.when(F.expr("id % 3 = 0"), 0).otherwise(F.col("modified_at")).alias("seen_mtime")).select("id", ingest.unchanged().alias("unchanged"))
)


def quick_listing(c: Catalog) -> DataFrame:
    return c.asset.select("source_id", "path", (F.coalesce("size_bytes", F.lit(0)) + F.when(F.expr("id % 6 = 0"), 1).otherwise(0)).alias("size"), F.col("modified_at").alias("mtime"))


QUICK = """SELECT a.source_id, a.path, l.size, a.modified_at AS mtime, a.id AS invalidated FROM asset a JOIN (SELECT id, coalesce(size_bytes, 0) + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS size FROM asset) l USING (id)
 WHERE NOT (a.modified_at IS NOT NULL AND l.size IS NOT DISTINCT FROM a.size_bytes)"""
query("quick_discovery", QUICK)(lambda c: ingest.quick_discovery(c.asset, c.pending_ingest, quick_listing(c)))
query("quick_surviving_tags", f"SELECT asset_id, tag_id, state FROM asset_tag WHERE NOT (source <> 'user' AND state <> 'rejected' AND asset_id IN (SELECT invalidated FROM ({QUICK})))")(lambda c: ingest.surviving_tags(c.asset_tag, ingest.quick_discovery(c.asset, c.pending_ingest, quick_listing(c))).select("asset_id", "tag_id", "state"))
query("pending_page", "SELECT path, revision FROM pending_ingest WHERE source_id = 'src1' AND coalesce(retry_after, 0) <= 1700000000030 AND path > 'a' ORDER BY path LIMIT 128")(lambda c: ingest.pending_page(c.pending_ingest, "src1", 1700000000030, "a").select("path", "revision"))
query("pending_commit", """SELECT p.source_id, p.path, CASE WHEN a.id % 7 = 0 THEN 'cancelled' WHEN a.id % 5 = 0 THEN 'stale' WHEN b.content_hash IS NOT NULL THEN 'blocked' ELSE 'written' END AS outcome
 FROM pending_ingest p JOIN asset a USING (source_id, path) LEFT JOIN blocklist b USING (content_hash)""")(
    lambda c: ingest.pending_commit(c.pending_ingest, c.pending_ingest.join(c.asset, ["source_id", "path"]).select("source_id", "path", (F.col("revision") + F.when(F.expr("id % 5 = 0"), 1).otherwise(0)).alias("revision"), "content_hash", F.expr("id % 7 = 0").alias("cancelled")), c.blocklist)
)
query("pending_retry", "SELECT source_id, path, attempts + CASE WHEN attempts = 2 THEN 1 ELSE 0 END AS attempts, CASE WHEN attempts = 2 THEN 30500 ELSE retry_after END AS retry_after FROM pending_ingest")(lambda c: ingest.retried(c.pending_ingest, c.pending_ingest.where("attempts = 2"), 500))
NOT_PENDING = "source_id NOT IN (SELECT source_id FROM source_table WHERE kind = 'federated') AND NOT EXISTS (SELECT 1 FROM pending_ingest p WHERE p.source_id = asset.source_id AND p.path = asset.path)"
query("plan_due", f"SELECT id FROM asset WHERE analysis_version < 3 AND {NOT_PENDING}")(lambda c: ingest.due(c.asset, c.pending_ingest, c.source_table).select("id"))
query("derivative_due", f"SELECT id FROM asset WHERE derivative_version < 3 AND media_type IN ('image', 'video', 'model') AND {NOT_PENDING}")(lambda c: ingest.derivatives_due(c.asset, c.pending_ingest, c.source_table).select("id"))
query("page_plan", f"SELECT id FROM asset WHERE {NOT_PENDING} AND analysis_version < 3 AND (analysis_version > 1 OR (analysis_version = 1 AND (source_id > 'src3' OR (source_id = 'src3' AND id > 40)))) ORDER BY analysis_version, source_id, id LIMIT 200")(lambda c: ingest.plan_page(ingest.due(c.asset, c.pending_ingest, c.source_table), (1, "src3", 40), 200).select("id"))
query("scan_batch", "SELECT source_id, CAST((r - 1) // 128 AS BIGINT) AS batch, count(*) AS n FROM (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY path) AS r FROM asset) GROUP BY 1, 2")(lambda c: ingest.scan_batches(c.asset).groupBy("source_id", "batch").agg(n()))
query("analysis_batch", "SELECT id, CASE WHEN id % 3 = 0 AND NOT (media_type = 'document' AND size_bytes IS NULL) THEN 3 ELSE analysis_version END AS analysis_version, CASE WHEN id % 3 = 0 AND NOT (media_type = 'document' AND size_bytes IS NULL) THEN 1800000000000 ELSE analysed_at END AS analysed_at, CASE WHEN id % 3 = 0 AND media_type = 'document' AND size_bytes IS NULL THEN 'no size' END AS error FROM asset")(
    lambda c: ingest.analysed(c.asset, c.asset.where("id % 3 = 0").select("id", F.when((F.col("media_type") == "document") & F.col("size_bytes").isNull(), "no size").alias("error")), 3, 1800000000000)
)
query("remove_block", "SELECT id FROM asset WHERE content_hash <> (SELECT content_hash FROM asset WHERE id = 21)")(lambda c: ingest.removed(c.asset, 21, True)[0].select("id"))
query("clear_analysis", "SELECT id, 0 AS analysis_version FROM asset")(lambda c: ingest.cleared(c.asset).select("id", "analysis_version"))
FOLDER_SQL = "WITH a AS (SELECT source_id, string_split(CASE WHEN id % 22 = 0 THEN concat('moved/', path) ELSE path END, '/') AS parts FROM asset WHERE id % 11 <> 0 OR id % 22 = 0), f AS (SELECT source_id, len(parts) - 1 AS depth, unnest(range(0, len(parts))) AS k, parts FROM a) SELECT source_id, array_to_string(parts[1:k], '/') AS folder, count(*) FILTER (WHERE k = depth) AS direct, count(*) AS descendant FROM f GROUP BY 1, 2"
STAT = "count(*) AS n, count(*) FILTER (WHERE (flags & 1) <> 0) AS missing, count(*) FILTER (WHERE analysed_at IS NULL) AS unanalysed"


@query("repair_aggregates", f"SELECT media_type, n, missing, unanalysed, CASE WHEN media_type = 'audio' THEN n + 5 END AS kept_n FROM (SELECT media_type, {STAT} FROM asset GROUP BY 1) WHERE media_type IN ('audio', 'video')")
def repair_aggregates(c: Catalog) -> DataFrame:
    """Kept counters of which one is wrong and one is lost."""
    kept = aggregates.maintained(c, "media_stat").where("media_type <> 'video'").withColumn("n", F.col("n") + F.when(F.col("media_type") == "audio", 5).otherwise(0))
    return aggregates.drift(kept, c.asset, ["media_type"]).select("media_type", "n", "missing", "unanalysed", "kept_n")


@query("agg_counter_feed", f"SELECT source_id, media_type, {STAT} FROM (SELECT source_id, CASE WHEN id % 17 = 0 THEN 'video' ELSE media_type END AS media_type, CASE WHEN id % 17 = 0 THEN flags | 1 ELSE flags END AS flags, analysed_at FROM asset WHERE id % 9 <> 0 OR id % 17 = 0) GROUP BY 1, 2")
def agg_counter_feed(c: Catalog) -> DataFrame:
    """Counters after two batches of a feed, of which the first comes twice: they are those of a recount."""
    kept = counters.Counters(c.spark, f"{shared_folder(c.spark)}/counters-{uuid.uuid4().hex}")
    kept.build(c)
    moved = c.asset.where("id % 17 = 0")
    after = moved.withColumns({"media_type": F.lit("video"), "flags": F.col("flags").bitwiseOR(1)})
    gone = counters.images(c.asset.where("id % 9 = 0 AND id % 17 <> 0"), "before")
    for rows, batch in ((gone, 0), (gone, 0), (counters.images(moved, "before").unionByName(counters.images(after, "after")), 1)):
        kept.apply(rows, "feed", batch)
    return kept.table().select("source_id", "media_type", *aggregates.COUNTERS)


@query("agg_folder_deltas", FOLDER_SQL)
def agg_folder_deltas(c: Catalog) -> DataFrame:
    """A kept roll-up after files have moved and gone."""
    moved = c.asset.where("id % 11 = 0")
    after = moved.where("id % 22 = 0").withColumn("path", F.concat(F.lit("moved/"), "path"))
    return aggregates.with_folder_deltas(aggregates.folder_rollup(c.asset), aggregates.folder_deltas(moved, after))


@query("agg_counter_deltas", f"SELECT source_id, media_type, {STAT} FROM (SELECT source_id, CASE WHEN id % 9 = 0 THEN 'video' ELSE media_type END AS media_type, CASE WHEN id % 9 = 0 THEN flags | 1 ELSE flags END AS flags, CASE WHEN id % 9 = 0 THEN NULL ELSE analysed_at END AS analysed_at FROM asset WHERE id % 17 <> 0) GROUP BY 1, 2")
def agg_counter_deltas(c: Catalog) -> DataFrame:
    """Kept counters after some assets changed and some went, from the changed rows alone."""
    keys = ["source_id", "media_type"]
    before = c.asset.where("id % 9 = 0 OR id % 17 = 0")
    after = before.where("id % 17 <> 0").withColumns({"media_type": F.lit("video"), "flags": F.col("flags").bitwiseOR(1), "analysed_at": F.lit(None).cast("long")})
    return aggregates.with_deltas(aggregates.maintained(c, "source_media_stat"), aggregates.counter_deltas(before, after, keys), keys)


def wiped_left(c: Catalog) -> DataFrame:
    """Rows of each table once a catalogue is wiped; what is none of its tables stays."""
    left = ingest.wiped({t: getattr(c, t) for t in WIPE})[0]
    return reduce(DataFrame.unionByName, [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t, rows in left.items()])


query("wipe_catalog", "SELECT 'asset' AS name, count(*) AS n FROM asset UNION ALL SELECT 'source_table', count(*) FROM source_table UNION ALL SELECT 'collection', count(*) FROM collection UNION ALL SELECT 'tag', count(*) FROM tag")(lambda c: ingest.wiped({t: getattr(c, t) for t in ("asset", "source_table", "collection", "tag", "asset_tag")})[1])
WIPE = ("asset", "source_table", "collection", "tag", "asset_tag", "collection_member", "blocklist", "pending_ingest")
query("wipe_catalog_left", " UNION ALL ".join(f"SELECT '{t}' AS name, {'count(*)' if t == 'pending_ingest' else 'CAST(0 AS BIGINT)'} AS n{f' FROM {t}' if t == 'pending_ingest' else ''}" for t in WIPE))(wiped_left)
JOBS = "(SELECT event_id AS id, event_type AS kind, CASE WHEN user_id % 3 = 0 THEN 'done' ELSE 'failed' END AS state, epoch_us(ts) // 1000 AS created_at FROM events)"
TOUCHED = """CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '["src1", src2' WHEN 2 THEN '[]' ELSE concat('["src', user_id % 4, '","src', event_id % 5, '"]') END AS sources,
 CASE WHEN event_id % 4 = 0 THEN concat('["', event_id % 5, '"]') END AS collections"""
OPEN = "CASE WHEN json_valid({0}) THEN from_json({0}, '[\"VARCHAR\"]') ELSE [] END AS {0}"


@query("jobs_under_ceiling", f"""WITH j AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS created_at, {TOUCHED} FROM events),
t AS (SELECT id, created_at, {OPEN.format('sources')}, {OPEN.format('collections')} FROM j)
SELECT id, created_at FROM t WHERE len(sources) + len(collections) > 0
 AND list_has_all(['src1', 'src2', 'src3'], sources) AND list_has_all(['1', '2'], collections)""")
def jobs_under_ceiling(c: Catalog) -> DataFrame:
    created = F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at")
    jobs = c.base("events").select(F.col("event_id").alias("id"), created, "event_id", "user_id").selectExpr("id", "created_at", *[line.strip().rstrip(",") for line in TOUCHED.split("\n")])
    return review.jobs_visible(jobs, Visibility.only(["src1", "src2", "src3"], [1, 2])).select("id", "created_at")


query("page_jobs", f"SELECT id, kind, created_at FROM {JOBS} WHERE kind IN ('click', 'view') AND state = 'done' AND (created_at < 1704100000000 OR (created_at = 1704100000000 AND id < 500)) ORDER BY created_at DESC, id DESC LIMIT 51")(
    lambda c: review.jobs_page(c.base("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("user_id") % 3 == 0, "done").otherwise("failed").alias("state"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at")), ["click", "view"], "done", (1704100000000, 500), 50).select("id", "kind", "created_at")
)
query("upload_ingest", "SELECT source_id, path, 'new' AS outcome FROM (SELECT source_id, concat('up/', path) AS path FROM asset WHERE id % 50 = 0)")(
    lambda c: ingest.upsert(c.asset, c.asset.where("id % 50 = 0").withColumn("path", F.concat(F.lit("up/"), "path")), 1).where("outcome = 'new'").select("source_id", "path", "outcome")
)

# Review


def suggestions(c: Catalog) -> DataFrame:
    return c.asset.where("id % 4 = 0").select(F.col("id").alias("asset_id"), (F.col("id") % 25).alias("tag_id"), F.lit(1.5).alias("confidence"))


query(
    "tag_suggest",
    """SELECT coalesce(x.asset_id, s.asset_id) AS asset_id, coalesce(x.tag_id, s.tag_id) AS tag_id, coalesce(x.state, 'suggested') AS state, coalesce(x.source, 'auto') AS source, CASE WHEN s.asset_id IS NOT NULL AND (x.state IS NULL OR (x.state = 'suggested' AND x.source = 'auto')) THEN 1.0e0 ELSE x.confidence END AS confidence
 FROM asset_tag x FULL JOIN (SELECT id AS asset_id, id % 25 AS tag_id FROM asset WHERE id % 4 = 0) s ON x.asset_id = s.asset_id AND x.tag_id = s.tag_id""",
)(lambda c: review.suggest(c.asset_tag, suggestions(c)))
query(
    "tag_review",
    """SELECT r.asset_id, r.tag_id, r.action, CASE WHEN x.state = 'suggested' AND r.action = 'accept' THEN 'confirmed' WHEN x.state = 'suggested' AND r.action = 'reject' THEN 'rejected' WHEN x.state IN ('confirmed', 'rejected') AND r.action = 'undo' THEN 'suggested' ELSE x.state END AS state,
 CASE WHEN x.state IS NULL THEN 'not_found' WHEN (x.state = 'suggested' AND r.action IN ('accept', 'reject')) OR (x.state IN ('confirmed', 'rejected') AND r.action = 'undo') THEN 'ok' ELSE 'bad_request' END AS outcome
 FROM (SELECT asset_id, tag_id, CASE asset_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'undo' END AS action FROM asset_tag) r LEFT JOIN asset_tag x ON x.asset_id = r.asset_id AND x.tag_id = r.tag_id AND x.source = 'auto'""",
)(lambda c: review.reviewed(c.asset_tag, c.asset_tag.select("asset_id", "tag_id", F.when(F.expr("asset_id % 3 = 0"), "accept").when(F.expr("asset_id % 3 = 1"), "reject").otherwise("undo").alias("action"))))
EDIT_IDS = [2, 3, 4, 6, 8, 10, 50]
query(
    "tag_edit_bulk",
    f"""SELECT i.id AS asset_id, count(*) FILTER (WHERE w.kind = 'add' AND NOT coalesce(x.state = 'confirmed' AND x.source = 'user', FALSE)) AS additions, count(*) FILTER (WHERE w.kind = 'remove' AND coalesce(x.source = 'user', FALSE)) AS removals
 FROM (SELECT CAST(unnest({EDIT_IDS}) AS BIGINT) AS id) i CROSS JOIN (VALUES ('texture', 'add'), ('brandnew', 'add'), ('music', 'remove'), ('prop', 'remove')) w(name, kind) LEFT JOIN tag t ON lower(t.name) = w.name LEFT JOIN asset_tag x ON x.asset_id = i.id AND x.tag_id = t.tag_id GROUP BY 1""",
)(lambda c: review.edited(c.asset_tag, c.tag, EDIT_IDS, [" Texture", "BrandNew"], ["music", "prop"]))
PATCHED = """SELECT id, license_id, TRUE AS commercial, modify, redistribute, attribution, CAST(NULL AS VARCHAR) AS holder, credit, CASE WHEN license_id IS NULL OR modify IS NULL OR redistribute IS NULL OR attribution IS NULL THEN 'unknown' WHEN NOT modify OR NOT redistribute THEN 'restricted' WHEN attribution THEN 'attribution' ELSE 'permissive' END AS license_status
 FROM asset WHERE id IN (1, 2, 3, 5, 8, 13, 16, 19, 21, 34) AND (commercial IS DISTINCT FROM TRUE OR holder IS NOT NULL)"""
query("license_patch", PATCHED)(lambda c: review.license_patched(c.asset, [1, 2, 3, 5, 8, 13, 16, 19, 21, 34], review.LicensePatch(commercial=True, holder="  ")))
query("license_status", "SELECT id, license_status FROM asset")(lambda c: c.asset.select("id", review.license_status().alias("license_status")))
query("favorite_set", "SELECT id, CASE WHEN id IN (1, 2, 3) THEN flags | 2 ELSE flags END AS flags FROM asset")(lambda c: review.favorite_set(c.asset, [1, 2, 3], True))
query("note_set", "SELECT asset_id, body FROM asset_note WHERE asset_id % 4 <> 0 UNION ALL SELECT id, 'new' FROM asset WHERE id % 25 = 1 AND id % 6 <> 0")(
    lambda c: review.notes_set(c.asset_note, c.asset_note.where("asset_id % 4 = 0").select("asset_id", F.lit("  ").alias("body")).unionByName(c.asset.where("id % 25 = 1 AND id % 6 <> 0").select(F.col("id").alias("asset_id"), F.lit(" new ").alias("body"))))
)


def comments(c: Catalog) -> DataFrame:
    rows = c.base("conversations")
    key = (F.col("conv_id") * 100 + F.col("turn")).alias("comment_id")
    return rows.select(key, (F.col("conv_id") % 9).alias("asset_id"), F.when(F.col("turn") > 0, F.col("conv_id") * 100 + F.col("turn") - 1).when(F.col("conv_id") > 0, (F.col("conv_id") - 1) * 100).alias("reply_to"), F.col("text").alias("body"), F.expr("(conv_id + turn) % 4 = 0").alias("deleted"))


COMMENTS = "SELECT conv_id * 100 + turn AS comment_id, conv_id % 9 AS asset_id, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 WHEN conv_id > 0 THEN (conv_id - 1) * 100 END AS reply_to, text AS body, (conv_id + turn) % 4 = 0 AS deleted FROM conversations"
WRITTEN = f"""WITH k AS ({COMMENTS}), s AS (SELECT comment_id, asset_id, reply_to, CASE WHEN deleted THEN '' ELSE body END AS body, deleted FROM k)
SELECT comment_id, asset_id, reply_to, CASE WHEN deleted OR comment_id % 7 = 0 THEN '' WHEN comment_id % 5 = 0 THEN concat(body, '!') ELSE body END AS body, CASE WHEN NOT deleted AND comment_id % 5 = 0 THEN 9 END AS edited_at, CASE WHEN deleted THEN 1 WHEN comment_id % 7 = 0 THEN 9 END AS deleted_at FROM s
UNION ALL SELECT -1 - comment_id, asset_id, comment_id, 'reply', NULL, NULL FROM s WHERE comment_id % 3 = 0 AND asset_id IN (SELECT id FROM asset)"""


@query("comment_writes", WRITTEN)
def comment_writes(c: Catalog) -> DataFrame:
    """Replies (some to another asset's comment, which are refused), edits and deletions in one batch."""
    old = comments(c).select("comment_id", "asset_id", "reply_to", F.when(F.col("deleted"), "").otherwise(F.col("body")).alias("body"), F.lit(1).cast("long").alias("created_at"), F.lit(None).cast("long").alias("edited_at"), F.when(F.col("deleted"), F.lit(1)).cast("long").alias("deleted_at"))
    write = lambda rows, op, **kept: rows.select(F.lit(op).alias("op"), *[kept.get(x, F.col(x)).alias(x) for x in ("comment_id", "asset_id", "reply_to", "body")])
    reply = {"comment_id": -1 - F.col("comment_id"), "reply_to": F.col("comment_id"), "body": F.lit("reply")}
    stray = reply | {"comment_id": -1_000_000_000 - F.col("comment_id"), "asset_id": F.col("asset_id") + 2}
    edits = [write(old.where("comment_id % 3 = 0"), "add", **reply), write(old.where("comment_id % 3 = 0"), "add", **stray), write(old.where("comment_id % 5 = 0"), "edit", body=F.concat("body", F.lit("!"))), write(old.where("comment_id % 7 = 0"), "delete")]
    return review.comments_written(old, reduce(DataFrame.unionByName, edits), c.asset, 9).select("comment_id", "asset_id", "reply_to", "body", "edited_at", "deleted_at")


query("comment_threads", f"WITH k AS ({COMMENTS}) SELECT k.comment_id, k.asset_id, CASE WHEN p.asset_id = k.asset_id THEN k.reply_to END AS reply_to, CASE WHEN NOT k.deleted THEN k.body END AS body FROM k LEFT JOIN k p ON p.comment_id = k.reply_to")(lambda c: review.threads(comments(c)))
REVIEWS = "SELECT DISTINCT content_hash AS review_key, CASE WHEN content_hash < '5' THEN 'resolved' ELSE 'dismissed' END AS state FROM asset WHERE content_hash < 'a'"


def reviews(c: Catalog) -> DataFrame:
    return c.asset.where("content_hash < 'a'").select(F.col("content_hash").alias("review_key"), F.when(F.col("content_hash") < "5", "resolved").otherwise("dismissed").alias("state")).distinct()


GROUPS = "SELECT content_hash, count(*) AS n FROM asset GROUP BY 1 HAVING count(*) > 1"
query("dup_review", f"SELECT g.content_hash, g.n, coalesce(r.state, 'pending') AS state FROM ({GROUPS}) g LEFT JOIN ({REVIEWS}) r ON r.review_key = g.content_hash")(lambda c: review.reviewed_groups(aggregates.duplicate_groups(c.asset), reviews(c), "all"))
query("dup_review_filter", f"SELECT g.content_hash, g.n, 'resolved' AS state FROM ({GROUPS}) g JOIN ({REVIEWS}) r ON r.review_key = g.content_hash WHERE r.state = 'resolved'")(lambda c: review.reviewed_groups(aggregates.duplicate_groups(c.asset), reviews(c), "resolved"))
query("collection_add", "SELECT * FROM (SELECT collection_id, asset_id FROM collection_member UNION SELECT 1, id FROM asset WHERE id % 10 = 1) WHERE NOT (collection_id = 1 AND asset_id % 4 = 0)")(
    lambda c: review.members_changed(c.collection, c.collection_member, 1, c.asset.where("id % 10 = 1").select(F.col("id").alias("asset_id")), c.asset.where("id % 4 = 0").select(F.col("id").alias("asset_id")))
)
query("folder_list", "SELECT DISTINCT split_part(substr(path, 4), '/', 1) AS name FROM asset WHERE starts_with(path, 'en/') AND contains(substr(path, 4), '/')")(lambda c: aggregates.child_folders(c.asset, "en"))
query("bulk_targets", "SELECT id, source_id = 'src2' AS writable FROM asset WHERE id IN (SELECT asset_id FROM collection_member WHERE collection_id = 3)")(lambda c: review.bulk_targets(visible(c, c.asset, Visibility.only(collections=[3])), ["src2"]))
SAVED = '{"filters": [{"field": "media_type", "op": "eq", "value": "image"}, {"field": "favorite", "op": "eq", "value": true}]}'
query("collection_smart", "SELECT id FROM asset WHERE media_type = 'image' AND (flags & 2) <> 0 AND (source_id IN ('src1', 'src2') OR id IN (SELECT asset_id FROM collection_member WHERE collection_id = 3))")(lambda c: smart_members(c, SAVED, Visibility.only(sources=["src1", "src2"], collections=[3])).select("id"))
query("collection_smart_unreadable", "SELECT id FROM asset WHERE FALSE")(lambda c: smart_members(c, '{"filters": [{"field": "no such field", "op": "eq", "value": 1}]}').select("id"))

# Sources, exports, conversion, federation

NAMES = ["a.wav", "b.OGA", "c.aif", "d.jpeg", "e.tif", "f.markdown", "g.usda", "h.ogv", "LICENSE", "Licence-MIT", "i.svg", "j.xm", "k.zip", "l.MP4", "m.ktx", "readme", "n.3ds", "notice.pdf", ".txt", "o.md"]
FOUND = ["audio:wav", "audio:ogg", "audio:aiff", "image:jpg", "image:tiff", "document:md", "model:usda", "video:ogv", "document:txt", "document:txt", "image:svg", "audio:xm", None, "video:mp4", "image:ktx", None, "model:3ds", "document:pdf", None, "document:md"]
query("detect_format", f"SELECT id, split_part(x, ':', 1) AS media, split_part(x, ':', 2) AS format FROM (SELECT id, [{', '.join('NULL' if x is None else repr(x) for x in FOUND)}][id % {len(NAMES)} + 1] AS x FROM asset)")(
    lambda c: c.asset.select("id", F.concat(F.lit("dir/"), F.array(*[F.lit(x) for x in NAMES])[(F.col("id") % len(NAMES)).cast("int")]).alias("p")).select("id", exchange.detected_media(F.col("p")).alias("media"), exchange.detected_format(F.col("p")).alias("format"))
)
query("detect_ingest_policy", "SELECT id, NOT (media_type = 'document' AND id % 3 = 0) AS admitted FROM asset")(lambda c: c.asset.select("id", exchange.admitted(F.when(F.expr("id % 3 = 0"), F.concat(F.lit("a/Node_Modules/"), "path")).otherwise(F.col("path"))).alias("admitted")))
query("refine_container", "SELECT asset_id, CASE WHEN asset_id % 3 = 0 THEN 'audio' ELSE 'video' END AS media FROM video_attr")(lambda c: c.video_attr.select("asset_id", exchange.refined(F.lit("video"), F.col("container"), F.expr("CASE WHEN asset_id % 3 = 0 THEN FALSE WHEN asset_id % 3 = 1 THEN TRUE END")).alias("media")))
for _name, _keep in (("source_walk", None), ("source_walk_filtered", "*.parquet")):
    query(_name)(lambda c, k=_keep: exchange.walk(c.spark, c.sf_dir, pattern=k).select("path", "size"))
query("source_fetch")(lambda c: exchange.fetched(c.spark, c.sf_dir).select("path", "size", "sha"))
query("source_walk_scoped")(lambda c: exchange.walk(c.spark, c.sf_dir, scopes=["region.parquet", "nation.parquet"]).select("path", "size"))
@query("export_json", "SELECT id, filename, license_status FROM asset")
def export_json(c: Catalog) -> DataFrame:
    """The written document, its asset lines read again."""
    out = events.fresh_folder(c.spark)
    exchange.write_manifest(projections.manifest(c, c.asset), out, "json")
    lines = c.spark.read.text(out).where("value LIKE ',{%' OR value LIKE '{\"id%'").select(F.from_json(F.regexp_replace("value", "^,", ""), "id long, filename string, license_status string").alias("r"))
    return lines.select("r.*")


@query("export_csv", "SELECT id, filename, coalesce(tags, '') AS tags FROM asset LEFT JOIN (SELECT x.asset_id, string_agg(t.name, ';' ORDER BY t.name) AS tags FROM asset_tag x JOIN tag t USING (tag_id) WHERE x.state = 'confirmed' GROUP BY 1) ON asset_id = id")
def export_csv(c: Catalog) -> DataFrame:
    out = events.fresh_folder(c.spark)
    exchange.write_manifest(projections.manifest(c, c.asset), out, "csv")
    return c.spark.read.option("header", True).csv(out).select(F.col("id").cast("long"), "filename", F.coalesce("tags", F.lit("")).alias("tags"))


query("export_sidecar", "SELECT id, concat(filename, CASE WHEN n = 0 THEN '' ELSE concat('-', n) END, '.json') AS file FROM (SELECT id, replace(p, ' ', '_') AS filename, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS n FROM (SELECT a.id, part.p_name AS p FROM asset a JOIN part ON part.p_partkey * 2 + 1 = a.id))")(
    lambda c: exchange.sidecars(c.base("part").select((F.col("p_partkey") * 2 + 1).alias("id"), F.col("p_name").alias("filename"))).select("id", "file")
)
TAKEN = "id % 9 = 0"
PLAN = """(SELECT p.id, p.size_bytes, p.stem, p.base, row_number() OVER (PARTITION BY p.base ORDER BY p.id) - 1 + CASE WHEN t.base IS NOT NULL THEN 1 ELSE 0 END AS k FROM (SELECT id, size_bytes, regexp_replace(filename, '\\.[^.]*$', '') AS stem, concat(regexp_replace(filename, '\\.[^.]*$', ''), '.ogg') AS base FROM asset) p
 LEFT JOIN (SELECT DISTINCT concat(regexp_replace(filename, '\\.[^.]*$', ''), '.ogg') AS base FROM asset WHERE id % 9 = 0) t USING (base))"""


def taken(c: Catalog) -> DataFrame:
    return c.asset.where(TAKEN).select(F.concat(F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit(".ogg")).alias("path"))


query("convert_plan", f"SELECT id, size_bytes, CASE WHEN k = 0 THEN base ELSE concat(stem, '-', k, '.ogg') END AS target, 'done' AS outcome FROM {PLAN}")(lambda c: exchange.convert_plan(c.asset, "ogg", taken(c), "suffix"))
query("convert_plan_skip", f"SELECT id, size_bytes, CASE WHEN k = 0 THEN base END AS target, CASE WHEN k = 0 THEN 'done' ELSE 'collision' END AS outcome FROM {PLAN}")(lambda c: exchange.convert_plan(c.asset, "ogg", taken(c), "skip"))
query("agg_convert_tally", f"SELECT count(*) FILTER (WHERE k = 0) AS done, count(*) FILTER (WHERE k > 0) AS failed, CAST(0 AS BIGINT) AS collisions, coalesce(sum(size_bytes) FILTER (WHERE k = 0), 0)::BIGINT AS bytes FROM {PLAN}")(lambda c: exchange.convert_tally(exchange.convert_plan(c.asset, "ogg", taken(c), "fail")))


def peers(c: Catalog) -> list[DataFrame]:
    rows = c.asset.select("id", "filename", F.col("size_bytes").alias("size"))
    return [exchange.tagged(rows.where(f"id % 3 = {k}"), f"peer{k}", k == 0) for k in range(3)]


STREAMS = "(SELECT id, filename, size_bytes AS size, concat('peer', id % 3) AS peer, id % 3 = 0 AS local, row_number() OVER (PARTITION BY id % 3 ORDER BY filename, id) AS rank FROM asset)"
query("fed_merge", f"SELECT id, peer FROM {STREAMS} ORDER BY lower(filename) ASC NULLS FIRST, filename ASC NULLS FIRST, local DESC, CAST(id AS VARCHAR) LIMIT 100")(lambda c: exchange.merged(peers(c), "name", False, 100, [F.col("filename"), F.col("id")]).select("id", "peer"))
query("win_fed_interleave", f"SELECT id, peer, CAST(rank AS INT) AS rank FROM {STREAMS} ORDER BY rank, local DESC, CAST(id AS VARCHAR) LIMIT 90")(lambda c: exchange.merged(peers(c), "relevance", False, 90, [F.col("filename"), F.col("id")]).select("id", "peer", "rank"))
query("fed_query", f"SELECT id, peer, size, TRUE AS partial, 'peer2' AS missing FROM {STREAMS} WHERE peer <> 'peer2' ORDER BY size DESC NULLS LAST, local DESC, CAST(id AS VARCHAR) LIMIT 100")(lambda c: exchange.answered(exchange.merged(peers(c)[:2], "size", True, 100, [F.col("filename"), F.col("id")]), ["peer0", "peer1", "peer2"], ["peer0", "peer1"]).select("id", "peer", "size", "partial", F.array_join("missing", ",").alias("missing")))


def federated(c: Catalog, **how) -> DataFrame:
    """A page by name of the own library and two peers, which stand here as src6 and src7."""
    rows = c.asset.select("id", "filename", F.col("size_bytes").alias("size"), "source_id")
    catalogues = {"src6": rows.where("id % 3 = 1"), "src7": rows.where("id % 3 = 2")}
    own = rows.where("id % 3 = 0 AND source_id NOT IN ('src6', 'src7')")
    page = exchange.federated(own, catalogues, "name", False, 200, [F.col("filename"), F.col("id")], **how)
    return page.select("id", "source_id", "partial", F.array_join("missing", ",").alias("missing"))


def sql_federated(rows: str, missing: str = "") -> str:
    """Some of the rows of all three libraries, in order of name."""
    return f"""WITH f AS (SELECT id, filename, id % 3 = 0 AS local, CASE id % 3 WHEN 1 THEN 'src6' WHEN 2 THEN 'src7' ELSE source_id END AS source_id
 FROM asset WHERE id % 3 <> 0 OR source_id NOT IN ('src6', 'src7'))
SELECT id, source_id, {bool(missing)} AS partial, '{missing}' AS missing FROM f WHERE {rows}
ORDER BY lower(filename) ASC NULLS FIRST, filename ASC NULLS FIRST, local DESC, CAST(id AS VARCHAR) LIMIT 200"""


query("fed_route_all", sql_federated("source_id <> 'src6'", "src6"))(lambda c: federated(c, silent=["src6"]))
query("fed_route_peer", sql_federated("source_id = 'src7'"))(lambda c: federated(c, source="src7"))
query("fed_route_local", sql_federated("source_id = 'src1'"))(lambda c: federated(c, source="src1", silent=["src6"]))
query("fed_route_ceiling", sql_federated("source_id IN ('src1', 'src2', 'src7')"))(lambda c: federated(c, allowed=["src1", "src2", "src7"]))
query("agg_fed_total", "SELECT sum(n)::BIGINT AS total FROM (SELECT id % 3 AS peer, count(*) AS n FROM asset GROUP BY 1)")(lambda c: exchange.fed_total(c.asset.groupBy((F.col("id") % 3).alias("peer")).agg(F.count(F.lit(1)).alias("total"))))
query("fed_gate", "SELECT concat('peer', n_nationkey) AS peer FROM nation WHERE n_nationkey % 3 = 1")(lambda c: exchange.same_protocol(c.base("nation").select(F.concat(F.lit("peer"), "n_nationkey").alias("peer"), F.concat((F.col("n_nationkey") % 3).cast("string"), F.lit("."), "n_nationkey").alias("protocol")), "1.0").select("peer"))


@query("fed_similar", f"{sql_spaces(3)}, s AS (SELECT * FROM v WHERE id = 7) SELECT v.id, round(list_cosine_similarity(v.vec, s.vec), 6) AS score FROM v, s WHERE v.space_id = 'space-1' ORDER BY score DESC, v.id % 2 = 0 DESC, v.id LIMIT 20")
def fed_similar(c: Catalog) -> DataFrame:
    from lumenshelf.operators import vectors

    rows = spaces(c, 3)
    seed = rows.where("id = 7").first()["vec"]
    scored = rows.select("id", "space_id", F.round(vectors.cosine(F.col("vec"), vectors.literal(seed)), 6).alias("score"))
    return exchange.fed_similar([exchange.tagged(scored.where("id % 2 = 0"), "here", True), exchange.tagged(scored.where("id % 2 = 1"), "there", False)], "space-1", 20).select("id", "score")


# Features

query("x_model_class", "SELECT asset_id, CASE WHEN triangle_count < 2000 THEN 'prop_lowpoly' WHEN triangle_count < 50000 OR triangle_count IS NULL THEN 'prop' ELSE 'prop_highpoly' END AS class FROM model_attr")(lambda c: c.model_attr.select("asset_id", features.model_class(F.col("triangle_count")).alias("class")))
query("x_video_class", "SELECT asset_id, CASE WHEN duration_ms < 5000 THEN 'sting' WHEN duration_ms < 60000 THEN 'clip' ELSE 'cutscene' END AS class, concat_ws(',', CASE WHEN has_audio = FALSE THEN 'silent' END, CASE WHEN width >= 3840 OR height >= 2160 THEN '4k' WHEN width >= 1920 OR height >= 1080 THEN '1080p' END) AS tags FROM video_attr")(
    lambda c: c.video_attr.select("asset_id", features.video_class(F.col("duration_ms")).alias("class"), F.array_join(features.video_tags(F.col("width"), F.col("height"), F.col("has_audio")), ",").alias("tags"))
)
query("x_text_class", "SELECT doc_id, CASE WHEN contains(lower(substr(text, 1, 600)), 'permission is hereby granted') OR contains(lower(substr(text, 1, 600)), 'all rights reserved') OR contains(lower(substr(text, 1, 600)), 'licensed under') THEN 'license' ELSE 'document' END AS class FROM documents")(lambda c: c.base("documents").select("doc_id", features.text_class(F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".txt")), F.col("text")).alias("class")))
AUDIO = "SELECT asset_id, log10(1 + duration_ms / 1000e0) AS a, coalesce(sample_rate, 0) / 48000e0 AS b, coalesce(channels, 0) / 2e0 AS c, coalesce(bit_depth, 0) / 24e0 AS d FROM audio_attr"
query("x_stats_vectors", f"SELECT asset_id, round(a / n, 6) AS v0, round(b / n, 6) AS v1, round(c / n, 6) AS v2, round(d / n, 6) AS v3 FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n FROM ({AUDIO}))")(lambda c: c.audio_attr.select("asset_id", features.audio_vector().alias("v")).select("asset_id", *[F.round(F.col("v")[k], 6).alias(f"v{k}") for k in range(4)]))
MODEL = "SELECT asset_id, log10(1e0 + vertex_count) AS a, log10(1e0 + coalesce(triangle_count, 0)) AS b, log10(1e0 + mesh_count) AS c, material_count / 8e0 AS d, texture_count / 8e0 AS e, CAST(coalesce(has_rig, FALSE) AS INT) AS f, CAST(coalesce(has_animation, FALSE) AS INT) AS g, CAST(coalesce(has_uv, FALSE) AS INT) AS h FROM model_attr"
query("x_model_vectors", f"SELECT asset_id, round(a / n, 6) AS v0, round(b / n, 6) AS v1, round(e / n, 6) AS v4, round(h / n, 6) AS v7 FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d + e * e + f + g + h) AS n FROM ({MODEL}))")(lambda c: c.model_attr.select("asset_id", features.model_vector().alias("v")).select("asset_id", *[F.round(F.col("v")[k], 6).alias(f"v{k}") for k in (0, 1, 4, 7)]))
VIDEO = "SELECT asset_id, log10(1 + duration_ms / 1000e0) AS a, log10(1e0 + width) AS b, log10(1e0 + height) AS c, fps / 60e0 AS d, log10(1e0 + bitrate) / 8 AS e, CAST(coalesce(has_audio, FALSE) AS INT) AS f FROM video_attr"
query("x_video_vectors", f"SELECT asset_id, round(a / n, 6) AS v0, round(c / n, 6) AS v2, round(e / n, 6) AS v4 FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d + e * e + f) AS n FROM ({VIDEO}))")(lambda c: c.video_attr.select("asset_id", features.video_vector().alias("v")).select("asset_id", *[F.round(F.col("v")[k], 6).alias(f"v{k}") for k in (0, 2, 4)]))
query("x_filename_tags", "SELECT DISTINCT id, name, 0.4e0 AS confidence FROM (SELECT id, format, unnest(regexp_extract_all(lower(filename), '[\\p{L}\\p{N}]+')) AS name FROM asset) WHERE strlen(name) >= 3 AND name <> lower(format) AND NOT regexp_full_match(name, '[0-9]+')")(lambda c: features.filename_tags(c.asset))
query("x_document", "SELECT doc_id, CASE WHEN length(flat) > 280 THEN concat(rtrim(substr(flat, 1, 280), ' '), '…') ELSE flat END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS flat FROM documents)")(lambda c: c.base("documents").select("doc_id", features.excerpt(F.col("text")).alias("excerpt")))
query("text_descriptor")(lambda c: features.text_vectors(c.base("documents").select(F.col("doc_id").alias("id"), "text")))

FLAT = r"regexp_replace(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g')"


@query("x_document_text", f"SELECT doc_id, nullif(length({FLAT}), 0) AS n_chars, CASE WHEN {FLAT} <> '' THEN md5({FLAT}) END AS digest FROM documents")
def x_document_text(c: Catalog) -> DataFrame:
    """Texts written as RTF, as UTF-16 and as UTF-8 files come back as they were, white space made even."""
    text = F.coalesce("text", F.lit(""))
    escaped = F.regexp_replace(text, r"([\\{}])", r"\\$1")
    rtf = F.concat(F.lit(r"{\rtf1{\fonttbl{\f0 Serif;}}\f0 "), F.regexp_replace(escaped, "\n", r"\\par "), F.lit("}"))
    kind = F.element_at(F.array(F.lit("rtf"), F.lit("txt"), F.lit("md")), (F.col("doc_id") % 3 + 1).cast("int"))
    content = F.when(kind == "rtf", F.encode(rtf, "UTF-8")).when(kind == "txt", F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).otherwise(F.encode(text, "UTF-8"))
    found = documents.texts(c.base("documents").select(F.col("doc_id").alias("id"), kind.alias("format"), content.alias("content")))
    return found.select(F.col("id").alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


# Texts stand in for decoded media: their bytes as samples.
query("x_image")(
    lambda c: media.image_table(c.base("documents").selectExpr("doc_id AS id", "CAST(ceil(octet_length(text) / 48) AS INT) AS height", "16 AS width", "3 AS channels", "rpad(encode(text, 'UTF-8'), CAST(ceil(octet_length(text) / 48) * 48 AS INT), X'20') AS data", "FALSE AS bgr"))
)
query("x_audio")(lambda c: media.sound_table(c.base("documents").select(F.col("doc_id").alias("id"), F.lit(8000).alias("rate"), F.encode("text", "UTF-8").alias("data"))))

# The change feed


def batch_events(c: Catalog) -> DataFrame:
    return c.base("events").withColumn("ts", F.col("ts").cast("timestamp"))


query("events_stream", "SELECT event_id, user_id, event_type FROM events")(lambda c: events.drained(events.change_feed(c.spark, f"{c.sf_dir}/events.parquet").select("event_id", "user_id", "event_type")))
query("events_topic", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")(lambda c: events.drained(events.on_topics(events.change_feed(c.spark, f"{c.sf_dir}/events.parquet"), ["click", "view"]).select("event_id")))
query("events_visibility", "SELECT event_id FROM events WHERE user_id % 10 = 7 OR user_id % 10 IN (1, 2)")(lambda c: events.drained(events.seen_events(events.change_feed(c.spark, f"{c.sf_dir}/events.parquet"), [1, 2], F.when(F.expr("user_id % 10 <> 7"), F.col("user_id") % 10)).select("event_id")))
query("events_lag", "SELECT user_id % 4 AS consumer, event_id AS resume_at, event_id - lag(event_id) OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS missed FROM events QUALIFY missed > 0")(lambda c: events.lag_markers(c.base("events").select((F.col("user_id") % 4).alias("consumer"), F.col("event_id").alias("first"), F.col("event_id").alias("last"))))
query(
    "watch_debounce",
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 600 MILLISECOND AS "end", count(*) AS changes, count(DISTINCT event_type) AS paths, count(DISTINCT event_type) > 512 AS rescan FROM
 (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 600 MILLISECOND THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, burst""",
)(lambda c: events.debounced(batch_events(c).withColumn("path", F.col("event_type")), "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "changes", "paths", "rescan"))
query("poll_backoff", "SELECT source_id, round((CASE WHEN contains(source_id, '1') THEN 15 ELSE 120 END) * (1 + 0.1e0 * (CAST(concat('0x', substr(md5(source_id), 1, 4)) AS INT) % 1000) / 1000), 3) AS seconds FROM source_table")(lambda c: c.source_table.select("source_id", events.next_poll(F.lit(60), F.col("source_id").contains("1"), F.col("source_id")).alias("seconds")))
query("batch_bounds", "SELECT event_type, CAST((r - 1) // 64 AS BIGINT) AS rows_part, CAST(0 AS BIGINT) AS bytes_part, count(*) AS n, sum(strlen(props))::BIGINT AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) GROUP BY 1, 2")(lambda c: events.flush_groups(c.base("events").withColumn("size", F.octet_length("props")), "size", "event_type", "event_id"))
query("job_progress", "SELECT user_id AS job, CASE WHEN bool_or(event_type = 'error') THEN 'cancelled' ELSE arg_max(event_type, event_id) END AS state, max(event_id) AS done, round(max(event_id) / 100000e0, 6) AS progress FROM events GROUP BY 1")(
    lambda c: events.job_state(c.base("events").select(F.col("user_id").alias("job"), F.col("event_id").alias("version"), F.when(F.col("event_type") == "error", "cancelled").otherwise(F.col("event_type")).alias("state"), F.col("event_id").alias("done"), F.lit(100000).alias("total")))
)
query("events_kept_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 10) AS large FROM events GROUP BY 1")(lambda c: events.drained_state(events.kept_counts(events.change_feed(c.spark, f"{c.sf_dir}/events.parquet"))))
query("ext_windowed_counts", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda c: events.windowed_counts(batch_events(c)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"))
TOPS = "SELECT vec_id AS id, list_transform(range(16), lambda k: list_max(list_transform(embedding[k * 4 + 1:k * 4 + 4], lambda x: abs(CAST(x AS DOUBLE))))) AS tops FROM embeddings"
query("agg_peaks", f"SELECT id, round(list_max(tops) / list_max(tops), 6) AS most, round(tops[1] / list_max(tops), 6) AS p0, round(tops[8] / list_max(tops), 6) AS p7, round(tops[16] / list_max(tops), 6) AS p15 FROM ({TOPS})")(
    lambda c: features.peak_rows(c.base("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("samples")), 16).select("id", *[F.round(x, 6).alias(k) for k, x in (("most", F.array_max("peaks")), ("p0", F.col("peaks")[0]), ("p7", F.col("peaks")[7]), ("p15", F.col("peaks")[15]))])
)
query("win_chroma_argmax", "SELECT id, CASE WHEN sum(e) > 0 AND max(e) >= 2.6 * sum(e) / 12 THEN arg_max(pitch, (e, pitch)) END AS pitch FROM (SELECT vec_id AS id, unnest(range(12)) AS pitch, unnest(list_transform(embedding[1:12], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS e FROM embeddings) GROUP BY 1")(
    lambda c: features.dominant_pitch(c.base("embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double") * x.cast("double"))).alias("pitch", "energy"))).select("id", F.col("pitch").cast("long").alias("pitch"))
)
