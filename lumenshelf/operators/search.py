"""Ranked text search: prefix groups with synonyms, BM25 over six columns, authored tier, substrings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions import text as T
from lumenshelf.functions.storage import settled, short_scans
from lumenshelf.functions.workers import map_arrow
from lumenshelf.operators.projections import confirmed_tags
from lumenshelf.sources.fixtures import Catalog

#: Searched columns with their BM25 weights; all but the last are authored.
WEIGHTS = {"filename": 10.0, "tokens": 5.0, "tags": 4.0, "note": 3.0, "folder": 2.0, "body": 1.0}
AUTHORED = ("filename", "tokens", "tags", "note", "folder")
K1, B = 1.2, 0.75
SUBSTRING_RANK, SHORT_WINDOW = 1e9, 4096
#: Tokens that are counted at once, or those of one row.
BATCH_TOKENS = 1 << 18
#: Rows of an index that one task sorts and writes.
RANGE_ROWS = 1 << 20
#: Bytes of files that one task reads to deal them to others, about a million postings; and of a row group, the unit
#: at which a file is cut for that, and which a term or gram leaves unread.
SCAN_BYTES, ROW_GROUP = 8 << 20, 4 << 20
#: Bytes that one task joins to search rows: those of the texts, and so many for each asset besides.
JOIN_BYTES, ASSET_BYTES = 64 << 20, 256


def search_rows(cat: Catalog) -> DataFrame:
    """Each asset with the tokens of its searched columns. All that meets is dealt by id to tasks of about JOIN_BYTES,
    so that a task sorts no more of a longer table, whatever the session's number of shuffle partitions."""
    bodies = cat.base("documents").select((F.col("doc_id") * 2).alias("id"), "text")
    n = join_parts(cat.asset, bodies)
    dealt = lambda rows: rows.repartition(n, "id")
    named = dealt(confirmed_tags(cat).withColumnRenamed("asset_id", "id"))
    tags = named.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("tag_text"))
    rows = dealt(cat.asset.select("id", "filename", "path")).join(tags, "id", "left")
    rows = rows.join(dealt(cat.asset_note.withColumnRenamed("asset_id", "id")), "id", "left").join(dealt(bodies), "id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "id", F.col("filename").alias("name"), T.plain_tokens(F.col("filename")).alias("filename"), T.name_tokens(F.col("filename")).alias("tokens"), T.plain_tokens(none("tag_text")).alias("tags"),
        T.plain_tokens(none("body")).alias("note"), T.folder_tokens(F.col("path")).alias("folder"), T.plain_tokens(none("text")).alias("body"),
    )


def join_parts(assets: DataFrame, bodies: DataFrame) -> int:
    """How many tasks join assets with their texts: as many as the bytes ask for, and few bytes are still spread over the cores."""
    size = assets.count() * ASSET_BYTES + (bodies.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    return max(size // JOIN_BYTES, min(size >> 20, assets.sparkSession.sparkContext.defaultParallelism)) + 1


def matched(rows: DataFrame, groups: list[list[str]], columns: tuple[str, ...] = tuple(WEIGHTS)) -> Column:
    """Every group matches in some column; different groups may match in different ones."""

    def group(g: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [T.matches(F.col(c), [g]) for c in columns])

    return reduce(lambda a, b: a & b, [group(g) for g in groups])


def ranked(rows: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Matching rows with bm25 (lower is better) and tier. Each prefix term is a phrase of its own: its
    frequency in a row is the sum over columns of weight times tokens that begin with it."""
    terms = sorted({t for g in groups for t in g})
    starts = lambda c, t: F.size(F.filter(F.col(c), lambda x: x.startswith(t)))
    tf = F.array(*[reduce(lambda a, b: a + b, [starts(c, t) * F.lit(w) for c, w in WEIGHTS.items()]) for t in terms])
    length = reduce(lambda a, b: a + b, [F.size(c) for c in WEIGHTS])
    scored = rows.withColumns({"tf": tf, "length": length, "hit": matched(rows, groups), "authored": matched(rows, groups, AUTHORED)}).select("id", "name", "tf", "length", "hit", "authored")
    counts = [F.count_if(F.col("tf")[k] > 0).alias(f"df{k}") for k in range(len(terms))]
    stats = scored.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *counts)
    joined = scored.where("hit").join(F.broadcast(stats))  # one row

    score = -reduce(lambda a, b: a + b, [bm25(F.col("tf")[k], F.col(f"df{k}")) for k in range(len(terms))])
    return joined.select("id", "name", score.alias("rank"), F.when(F.col("authored"), 0).otherwise(1).alias("tier"))


def bm25(tf: Column, df: Column) -> Column:
    """One term's part of a row's score, of columns n, mean and length."""
    idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))


def substring_hits(rows: DataFrame, text: str) -> DataFrame:
    """Names that contain the text of three characters or more, case and diacritics aside."""
    return rows.where(T.fold(F.col("name")).contains(T.fold(F.lit(text)))) if len(text) >= 3 else rows.where(F.lit(False))


def short_hits(assets: DataFrame, text: str) -> DataFrame:
    """For texts too short for an index: names that contain it among the newest assets."""
    newest = assets.orderBy(F.desc("id")).limit(SHORT_WINDOW)
    return newest.where(T.nocase(F.col("filename")).contains(T.nocase(F.lit(text))))


def hits(cat: Catalog, text: str) -> DataFrame:
    """All hits, in no order (id, name, rank, tier): authored words, other words, then substrings."""
    rows, groups = search_rows(cat), T.query_groups(text)
    empty = rows.select("id", "name", F.lit(0.0).alias("rank"), F.lit(0).alias("tier")).where(F.lit(False))
    words = ranked(rows, groups) if groups else empty
    rest = substring_hits(rows, text).select("id", "name").join(words.select("id"), "id", "left_anti")
    return words.unionByName(rest.select("id", "name", F.lit(SUBSTRING_RANK).alias("rank"), F.lit(2).alias("tier")))


def relevance() -> list[Column]:
    """The order of hits: tier, rank to six places (so that equal texts tie), length of name, name and id."""
    return [F.col("tier"), F.round("rank", 6), F.length("name"), F.col("name"), F.col("id")]


def search(cat: Catalog, text: str, limit: int = 100, keep: DataFrame | None = None) -> DataFrame:
    """The first hits in order of relevance; with ``keep`` (id) only of those ids. The limit comes last, so
    each task keeps ``limit`` rows and no more."""
    found = hits(cat, text)
    return (found if keep is None else found.join(keep.select("id"), "id", "left_semi")).orderBy(*relevance()).limit(limit)


def counted(rows: DataFrame) -> DataFrame:
    """Search rows as id, name, length and posts: each distinct token of a row with its weight (how often in which
    columns, weighted) and authored. An id comes once, so tokens are counted where the row is, not by a grouping."""

    def parts(batch):
        tokens = np.cumsum(sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy().astype(np.int64) for c in batch.columns[3:]))
        cuts = [0, *(np.flatnonzero(np.diff(tokens // BATCH_TOKENS)) + 1).tolist(), batch.num_rows]
        return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            lists = [batch.column(3 + k) for k in range(len(WEIGHTS))]
            sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy() for c in lists]
            whole = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in lists])
            words = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in sizes])
            weight = np.repeat(list(WEIGHTS.values()), [n.sum() for n in sizes])
            authored = np.repeat([c in AUTHORED for c in WEIGHTS], [n.sum() for n in sizes])
            n_words, kept = max(len(words.dictionary), 1), whole[row]
            keys, place = np.unique((row * n_words + words.indices.to_numpy())[kept], return_inverse=True)
            sums = np.bincount(place, weight[kept], len(keys))
            told = np.bincount(place, authored[kept], len(keys)) > 0
            offsets = np.searchsorted(keys, np.arange(batch.num_rows + 1) * n_words).astype(np.int32)
            posts = pa.StructArray.from_arrays([words.dictionary.take(pa.array(keys % n_words)), pa.array(sums), pa.array(told)], ["term", "weight", "authored"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(offsets), posts)], ["id", "name", "length", "posts"])

    length = reduce(lambda a, b: a + b, [F.size(c) for c in WEIGHTS]).alias("length")
    return map_arrow(rows.select(F.col("id").cast("long").alias("id"), "name", length, *WEIGHTS), run, "id long, name string, length int, posts array<struct<term string, weight double, authored boolean>>")


def postings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An inverted index of search rows, each id once: term, id, weight and authored; and what the ranking needs of each
    row: id, name, length. Both read one written table, so that rows are made and counted once."""
    with short_scans(rows.sparkSession, SCAN_BYTES):
        once = settled(counted(rows), **{"parquet.block.size": ROW_GROUP})
    return once.select("id", F.explode("posts").alias("t")).select("t.term", "id", "t.weight", "t.authored"), once.select("id", "name", "length")


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in ranges of the keys, sorted within: written so, a prefix reads few files. With the id as last key, a
    common term takes as many ranges as it needs. Their number follows that of the rows, so that a task sorts about
    RANGE_ROWS however many there are, and few rows are still spread over the cores."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartitionByRange(max(n // RANGE_ROWS, min(n // 1024, cores)) + 1, *keys).sortWithinPartitions(*keys)


def write_in_order(rows: DataFrame, path: str, *keys: str) -> None:
    """Write rows in_order. Neither the task that deals rows to the ranges nor that of a range holds more of a longer table."""
    with short_scans(rows.sparkSession, SCAN_BYTES):
        in_order(rows, *keys).write.option("parquet.block.size", ROW_GROUP).parquet(path)


def ranked_by_postings(terms: DataFrame, lengths: DataFrame, groups: list[list[str]], n: int | None = None, total: int | None = None) -> DataFrame:
    """What ``ranked`` gives, from postings: only terms that begin like one of the query's are read, each a
    range of the index, and rows are met by id. The number of rows and their total length may be given; else they are counted."""
    wanted = sorted({t for g in groups for t in g})
    near = reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t in wanted])
    sums = [F.sum(F.when(F.col("term").startswith(t), F.col("weight")).otherwise(F.lit(0.0))).alias(f"tf{k}") for k, t in enumerate(wanted)]
    told = [F.max(F.col("term").startswith(t) & F.col("authored")).alias(f"au{k}") for k, t in enumerate(wanted)]
    found = terms.where(near).groupBy("id").agg(*sums, *told)
    counts = found.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))])
    if n is None:
        stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).join(counts)
    else:
        stats = counts.select(F.lit(n).alias("n"), F.lit(total / max(n, 1)).alias("mean"), "*")
    every = lambda name: reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [name(wanted.index(t)) for t in g]) for g in groups])
    met = found.where(every(lambda k: F.col(f"tf{k}") > 0)).join(lengths, "id").join(F.broadcast(stats))  # one row
    parts = [bm25(F.col(f"tf{k}"), F.col(f"df{k}")) for k in range(len(wanted))]
    return met.select("id", "name", (-reduce(lambda a, b: a + b, parts)).alias("rank"), F.when(every(lambda k: F.col(f"au{k}")), 0).otherwise(1).alias("tier"))


def text_filter(cat: Catalog, text: str) -> DataFrame:
    """The ids that a text selects, for counts and exports: words or substring."""
    rows, groups = search_rows(cat), T.query_groups(text)
    words = rows.where(matched(rows, groups)).select("id") if groups else rows.where(F.lit(False)).select("id")
    return words.union(substring_hits(rows, text).select("id")).distinct()


def after_relevance(tier: int, rank: float, name: str, last_id: int) -> Column:
    """Rows behind a place in the order of ``search``."""
    place = F.struct(F.lit(tier).alias("a"), F.lit(rank).alias("b"), F.lit(len(name)).alias("c"), F.lit(name).alias("d"), F.lit(last_id).cast("long").alias("e"))
    return F.struct(F.col("tier").alias("a"), F.col("rank").alias("b"), F.length("name").alias("c"), F.col("name").alias("d"), F.col("id").alias("e")) > place
