"""Tags, licences, notes, favourites, comments and duplicate reviews as table transitions."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.text import nocase
from lumenshelf.operators.filters import BadRequest, Visibility

PAIR = ["asset_id", "tag_id"]
KEEP = object()


def suggest(tags: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Tags with automatic suggestions (asset_id, tag_id, confidence) added. Only a suggestion still
    open and automatic is refreshed; what was decided or made by a user stays."""
    new = suggestions.groupBy(*PAIR).agg(F.max(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))).alias("n"))
    both = tags.join(new, PAIR, "full")
    fresh, open_ = F.col("state").isNull(), (F.col("state") == "suggested") & (F.col("source") == "auto")
    return both.select(*PAIR, F.coalesce("state", F.lit("suggested")).alias("state"), F.coalesce("source", F.lit("auto")).alias("source"), F.when((fresh | open_) & F.col("n").isNotNull(), F.col("n")).otherwise(F.col("confidence")).alias("confidence"))


def reviewed(tags: DataFrame, actions: DataFrame) -> DataFrame:
    """Tags after review actions (asset_id, tag_id, action: accept, reject, undo) on automatic ones.
    outcome tells an illegal step (bad_request) from an unknown suggestion (not_found)."""
    rows = actions.join(tags.where("source = 'auto'"), PAIR, "left")
    state, action = F.col("state"), F.col("action")
    step = F.when((state == "suggested") & (action == "accept"), "confirmed").when((state == "suggested") & (action == "reject"), "rejected").when(state.isin("confirmed", "rejected") & (action == "undo"), "suggested")
    outcome = F.when(state.isNull(), "not_found").when(step.isNull(), "bad_request").otherwise("ok")
    return rows.select(*PAIR, "action", F.coalesce(step, state).alias("state"), outcome.alias("outcome"))


def tag_names(names: list[str]) -> list[str]:
    """Trimmed and lower-case names, each once: at most 50, of 64 characters at most."""
    out = list(dict.fromkeys(n.strip().lower() for n in names if n.strip()))
    if len(out) > 50 or any(len(n) > 64 for n in out):
        raise BadRequest("at most 50 tags of 64 characters")
    return out


def edited(tags: DataFrame, vocabulary: DataFrame, ids: list[int], add: list[str], remove: list[str]) -> DataFrame:
    """Per asset: tags that an edit confirms for the user and user tags that it removes. The counts of a
    dry run are those of the edit itself."""
    spark = tags.sparkSession
    targets = F.array(*[F.lit(i).cast("long") for i in sorted(set(ids))])
    names = [(n, kind) for kind, ns in (("add", tag_names(add)), ("remove", tag_names(remove))) for n in ns]
    wanted = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in names])).alias("w")).select("w.*", F.explode(targets).alias("asset_id"))
    known = vocabulary.select("tag_id", nocase(F.col("name")).alias("name"))
    rows = wanted.join(F.broadcast(known), "name", "left").join(tags, PAIR, "left")
    mine = (F.col("state") == "confirmed") & (F.col("source") == "user")
    adds = (F.col("kind") == "add") & ~F.coalesce(mine, F.lit(False))
    removes = (F.col("kind") == "remove") & F.coalesce(F.col("source") == "user", F.lit(False))
    return rows.groupBy("asset_id").agg(F.count_if(adds).alias("additions"), F.count_if(removes).alias("removals"))


@dataclass(frozen=True)
class LicensePatch:
    """Three states per field: absent keeps, None clears, a value sets; blank text clears."""

    license_id: Any = KEEP
    commercial: Any = KEEP
    modify: Any = KEEP
    redistribute: Any = KEEP
    attribution: Any = KEEP
    holder: Any = KEEP
    credit: Any = KEEP


def license_status() -> Column:
    """unknown without an id or with any right unknown; else by what is denied or demanded."""
    rights = ("commercial", "modify", "redistribute", "attribution")
    unknown = F.col("license_id").isNull()
    for r in rights:
        unknown = unknown | F.col(r).isNull()
    return F.when(unknown, "unknown").when(~F.col("commercial") | ~F.col("modify") | ~F.col("redistribute"), "restricted").when(F.col("attribution"), "attribution").otherwise("permissive")


def license_patched(assets: DataFrame, ids: list[int], patch: LicensePatch) -> DataFrame:
    """The chosen assets that a patch changes, with their new licence columns and derived status."""
    rows = assets.where(F.col("id").isin(ids))
    changed = F.lit(False)
    new: dict[str, Column] = {}
    for f in fields(patch):
        value = getattr(patch, f.name)
        if value is KEEP:
            continue
        if isinstance(value, str):
            value = value.strip() or None
        new[f.name] = F.lit(value).cast("string" if f.name in ("license_id", "holder", "credit") else "boolean")
        changed = changed | ~F.col(f.name).eqNullSafe(new[f.name])
    rows = rows.where(changed).withColumns(new)
    return rows.select("id", *[f.name for f in fields(patch)], license_status().alias("license_status"))


def favorite_set(assets: DataFrame, ids: list[int], on: bool) -> DataFrame:
    bit = F.col("flags").bitwiseOR(2) if on else F.col("flags").bitwiseAND(-3)
    return assets.select("id", F.when(F.col("id").isin(ids), bit).otherwise(F.col("flags")).alias("flags"))


def notes_set(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes after changes (asset_id, body): blank text removes a note."""
    new = changes.select("asset_id", F.trim("body").alias("new"))
    both = notes.join(new, "asset_id", "full").select("asset_id", F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("body")).alias("body"))
    return both.where("body <> ''")


def threads(comments: DataFrame) -> DataFrame:
    """Comments (comment_id, asset_id, reply_to, body, deleted) as shown: deleted ones are tombstones
    without text, and a reply belongs to a comment of the same asset, or stands alone."""
    parents = comments.select(F.col("comment_id").alias("reply_to"), F.col("asset_id").alias("p_asset"))
    rows = comments.join(parents, "reply_to", "left")
    return rows.select("comment_id", "asset_id", F.when(F.col("p_asset") == F.col("asset_id"), F.col("reply_to")).alias("reply_to"), F.when(~F.col("deleted"), F.col("body")).alias("body"))


def comments_written(comments: DataFrame, edits: DataFrame, assets: DataFrame, now: int) -> DataFrame:
    """Comments (comment_id, asset_id, reply_to, body, created_at, edited_at, deleted_at) after a batch of writes
    (op: add, edit or delete, comment_id, asset_id, reply_to, body), at most one of a kind per comment.

    A comment is added to an asset that exists, under an id that is free, and as a reply only to a comment on the same asset that was
    there before, a tombstone too. An edit changes the body of what is not deleted. A deletion blanks the body and
    keeps the row, so that replies keep their parent; deleting again changes nothing. Edits of a batch come before its deletions. See ``refused``.
    """
    good = edits.join(refused(comments, edits, assets).select("op", "comment_id"), ["op", "comment_id"], "left_anti")
    none = F.lit(None).cast("long")
    added = good.where("op = 'add'").select("comment_id", "asset_id", "reply_to", "body", F.lit(now).cast("long").alias("created_at"), none.alias("edited_at"), none.alias("deleted_at"))
    edited = good.where("op = 'edit'").select("comment_id", F.col("body").alias("_body"), F.lit(True).alias("_edited"))
    deleted = good.where("op = 'delete'").select("comment_id", F.lit(True).alias("_deleted"))
    rows = comments.join(edited, "comment_id", "left").join(deleted, "comment_id", "left")
    live, edit = F.col("deleted_at").isNull(), F.col("_edited").isNotNull()
    gone = live & F.col("_deleted").isNotNull()
    body = F.when(gone, F.lit("")).when(live & edit, F.col("_body")).otherwise(F.col("body"))
    kept = rows.select("comment_id", "asset_id", "reply_to", body.alias("body"), "created_at", F.when(live & edit, F.lit(now)).otherwise(F.col("edited_at")).alias("edited_at"), F.when(gone, F.lit(now)).otherwise(F.col("deleted_at")).alias("deleted_at"))
    return kept.unionByName(added)


def refused(comments: DataFrame, edits: DataFrame, assets: DataFrame) -> DataFrame:
    """Writes that change nothing, and why: op, comment_id, reason (no_asset, taken, other_asset or not_found)."""
    there = comments.select("comment_id", F.col("deleted_at").isNull().alias("_live"))
    parents = comments.select(F.col("comment_id").alias("reply_to"), F.col("asset_id").alias("_p_asset"))
    known = assets.select(F.col("id").alias("asset_id")).distinct().withColumn("_asset", F.lit(True))
    rows = edits.join(there, "comment_id", "left").join(parents, "reply_to", "left").join(known, "asset_id", "left")
    add = F.when(F.col("_live").isNotNull(), "taken").when(F.col("_asset").isNull(), "no_asset").when(F.col("reply_to").isNotNull() & ~F.col("_p_asset").eqNullSafe(F.col("asset_id")), "other_asset")
    edit = F.when(~F.coalesce("_live", F.lit(False)), "not_found")
    reason = F.when(F.col("op") == "add", add).when(F.col("op") == "edit", edit)
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("op", "comment_id", "reason")


def reviewed_groups(groups: DataFrame, reviews: DataFrame, show: str) -> DataFrame:
    """Duplicate groups (content_hash, n) by review state (review_key, state): pending, resolved, dismissed or all."""
    rows = groups.join(reviews.withColumnRenamed("review_key", "content_hash"), "content_hash", "left").withColumn("state", F.coalesce("state", F.lit("pending")))
    return rows if show == "all" else rows.where(F.col("state") == show)


def members_changed(collections: DataFrame, members: DataFrame, collection: int, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Members (collection_id, asset_id) after ids (asset_id) were added to and removed from a manual collection."""
    kind = collections.where(F.col("collection_id") == collection).select("kind").first()
    if kind is None:
        raise BadRequest(f"no collection {collection}")
    if kind["kind"] == "smart":
        raise BadRequest("a smart collection follows its query and has no members to edit")
    own = F.lit(collection).cast("long").alias("collection_id")
    kept = members.select("collection_id", "asset_id").union(add.select(own, "asset_id")).distinct()
    return kept.join(remove.select(own, "asset_id"), ["collection_id", "asset_id"], "left_anti")


def bulk_targets(rows: DataFrame, writable: list[str]) -> DataFrame:
    """Which of the rows a caller may change: those of sources open to writing."""
    return rows.select("id", F.coalesce(F.col("source_id").isin(writable), F.lit(False)).alias("writable"))


def jobs_page(jobs: DataFrame, kinds: list[str], state: str | None, last: tuple[int, int] | None, limit: int) -> DataFrame:
    """Jobs (id, kind, state, created_at), newest first, behind the last one seen; one more than ``limit`` tells
    that there are more."""
    rows = jobs.where(F.col("kind").isin(kinds)) if kinds else jobs
    rows = rows.where(F.col("state") == state) if state is not None else rows
    if last is not None:
        rows = rows.where((F.col("created_at") <= last[0]) & ((F.col("created_at") < last[0]) | (F.col("id") < last[1])))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)


def names_in(raw: Column) -> Column:
    """The strings of a JSON list; nothing readable, and a list with a null, counts as empty."""
    found = F.from_json(raw, "array<string>")
    return F.when(found.isNotNull() & ~F.exists(found, lambda x: x.isNull()), found).otherwise(F.array().cast("array<string>"))


def jobs_visible(jobs: DataFrame, ceiling: Visibility) -> DataFrame:
    """Jobs (sources and collections as JSON lists) that may be watched: under a ceiling, those that touch something
    and nothing beyond it, since a job tells the paths it is at."""
    if ceiling.full:
        return jobs
    sources, collections = names_in(F.col("sources")), names_in(F.col("collections"))
    within = lambda names, seen: F.forall(names, lambda x: x.isin(sorted(map(str, seen))))
    return jobs.where((F.size(sources) + F.size(collections) > 0) & within(sources, ceiling.sources) & within(collections, ceiling.collections))
