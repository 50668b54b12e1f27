"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenshelf.llm.common import SPACE_RUN, cut, given_back, id_key, join_groups, set_apart, sized, text_or_empty

#: Code points of a normalised text that the second level hashes.
PREFIX_CHARS = 64
#: Slots for each pair of length and prefix hash that occurs twice, in the bitmap that tells which rows are
#: hashed in full, and the least and most slots: powers of two. The largest bitmap takes 64 MB in an executor.
SLOTS_PER_PAIR, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 16, 1 << 28


def normalised(text: str = "text") -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(text_or_empty(text), SPACE_RUN, " ")


def full_hash(norm: str | Column) -> Column:
    return F.sha2(norm, 256)


def raw_hash(text: str) -> Column:
    """Tells texts apart as they are, before their white space is made even."""
    return F.xxhash64(text_or_empty(text))


def duplicate_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows whose length and prefix hash occur twice, hashed in full: _id, _raw, text_sha256.

    One pass counts pairs of length and prefix hash; a pair that occurs twice has a length that does, so
    this settles both levels. The surviving pairs mark slots of a bitmap that grows with their number, so that
    few slots are shared, and goes to every executor as one row per 64 slots. A second pass hashes in full only rows whose slot
    is marked. A slot that two pairs share makes a hash in vain, never a wrong group: equal texts alone
    have equal full hashes. Beyond MOST_SLOTS / SLOTS_PER_PAIR pairs more rows are hashed in vain.
    """
    rows = docs.select(F.col(id_col).alias("_id"), raw_hash(text_col).alias("_raw"), normalised(text_col).alias("_t"))
    rows = rows.withColumns({"_len": F.octet_length("_t"), "_prefix": F.xxhash64(F.substring("_t", 1, PREFIX_CHARS))})
    pairs = cut(rows.groupBy("_len", "_prefix").count().where("count > 1").select("_len", "_prefix"))
    slots = min(max(LEAST_SLOTS, 1 << (SLOTS_PER_PAIR * pairs.count()).bit_length()), MOST_SLOTS)
    # Bits of a hash are never null, so that the join puts no test for null, with the text's hash in it, ahead of itself.
    slot = F.xxhash64("_len", "_prefix").bitwiseAND(F.lit(slots - 1).cast("long"))
    word, place = F.shiftright(slot, 6).alias("_word"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")
    marked = pairs.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("_bits"))
    hashed = rows.select("*", word).join(F.broadcast(cut(marked)), "_word").where(F.getbit("_bits", place) == 1)
    return cut(hashed.select("_id", "_raw", full_hash("_t").alias("text_sha256")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of two rows or more with equal normalised texts: text_sha256, keep_id, group_size, keep.

    keep is the row that stays: (no id, id, raw hash), the least of the group, so a null id stays only if
    the group has no other. Null texts equal the empty text. An empty table gives no groups.
    """
    return grouped(duplicate_candidates(docs, id_col, text_col))


def grouped(candidates: DataFrame) -> DataFrame:
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_raw").alias("raw")))
    groups = candidates.groupBy("text_sha256").agg(least.alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return cut(groups.where("group_size > 1").withColumn("keep_id", F.col("keep.id")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    A row that stands alone keeps itself. Rows that repeat both id and text each get the same values,
    so all of them read kept; ``drop_exact_duplicates`` leaves one. See duplicate_groups for nulls.
    """
    groups = duplicate_groups(docs, id_col, text_col).select("text_sha256", "keep_id", "group_size")
    rows = docs.select(F.col(id_col), full_hash(normalised(text_col)).alias("text_sha256"))
    joined = join_groups(rows, groups, "text_sha256", "group_size", docs.count(), F.col(id_col))
    return joined.select(
        id_col,
        F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns, without the dropped copies.

    Rows to drop are found on narrow keys and leave by an anti join on id and raw hash. Of rows that share
    the id that stays, those with the least raw hash stay, and of rows that repeat id and text as they are
    the first by the remaining columns.
    """
    candidates = duplicate_candidates(docs, id_col, text_col)
    groups = grouped(candidates).drop("keep_id")
    joined = join_groups(candidates, groups, "text_sha256", "group_size", docs.count(), F.col("_raw").cast("string"))
    rows = joined.where("group_size IS NOT NULL").withColumn("_idk", id_key("_id"))
    stays = F.col("_id").eqNullSafe(F.col("keep.id")) & (F.col("_raw") == F.col("keep.raw"))
    drops, _ = sized(rows.where(~stays).select("_idk", "_raw").distinct())
    twice, _ = sized(rows.where(stays).groupBy("_idk", "_raw").count().where("count > 1").select("_idk", "_raw"))
    base, names = set_apart(docs)
    keyed = base.withColumns({"_idk": id_key(names[id_col]), "_raw": raw_hash(names[text_col])})
    kept = keyed.join(drops, ["_idk", "_raw"], "left_anti")
    if twice.isEmpty():
        return given_back(kept, names)
    single = kept.join(twice, ["_idk", "_raw"], "left_anti")
    first = kept.join(twice, ["_idk", "_raw"], "left_semi").groupBy("_idk", "_raw").agg(F.min(F.struct(*base.columns)).alias("_row"))
    return given_back(single.select(*base.columns).unionByName(first.select("_row.*")), names)
