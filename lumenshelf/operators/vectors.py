"""Vector search, hybrid fusion and near duplicates by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenshelf.functions.storage import removed, settled
from lumenshelf.functions.workers import map_arrow
from lumenshelf.operators.filters import BadRequest

NEAR_COSINE = 0.92
RRF_K, LEXICAL_CAP, SEMANTIC_CAP, SEED_CAP = 60, 400, 400, 24
#: Fusion weights by mode: of the word hits, of the neighbours of the text's vector, and of those of the first word hits.
FUSION = {"hybrid": (1.0, 1.0, 1.0), "semantic": (0.3, 1.5, 0.7)}
#: Vectors in a block of the exact pair search.
BLOCK_ROWS = 1024
EPSILON = 1.1920929e-07


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; zero for vectors of different or no length, and for those without a norm."""
    na, nb = dot(a, a), dot(b, b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > EPSILON) & (nb > EPSILON)
    return F.when(fits, dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(F.lit(0.0))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(vectors: DataFrame, vector: list[float], k: int, space: str | None = None) -> DataFrame:
    """The k vectors (id, space_id, vec) nearest to one, by score then id. Only its space is searched."""
    rows = vectors if space is None else vectors.where(F.col("space_id") == space)
    return rows.select("id", F.round(cosine(F.col("vec"), literal(vector)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def spaces_of(vectors: DataFrame) -> DataFrame:
    """What a library tells others of its spaces: space_id, dim and n. Vectors compare within a row of it alone."""
    return vectors.where("vec IS NOT NULL").groupBy("space_id", F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def checked_vector(vectors: DataFrame, space: str, vector: list[float]) -> list[float]:
    """The vector, if the space exists and has its dimension."""
    first = vectors.where(F.col("space_id") == space).select(F.size("vec").alias("dim")).first()
    if first is None:
        raise BadRequest(f"unknown space {space}")
    if first["dim"] != len(vector):
        raise BadRequest(f"{space} has {first['dim']} dimensions, not {len(vector)}")
    return vector


def nearest_to_asset(vectors: DataFrame, asset: int, k: int, keep: DataFrame | None = None, space: str | None = None) -> DataFrame:
    """Neighbours of an asset in its space, itself left out; filters come before the cut at k. An asset
    without a vector has none."""
    seeds = vectors.where(F.col("id") == asset)
    seed = (seeds if space is None else seeds.where(F.col("space_id") == space)).orderBy("space_id").first()
    rows = vectors.where(F.col("id") != asset)
    if seed is None:
        return nearest(rows.where(F.lit(False)), [0.0], k)
    if keep is not None:
        rows = rows.join(keep.select("id"), "id", "left_semi")
    return nearest(rows, seed["vec"], k, seed["space_id"])


def blocks_of(rows: DataFrame, key: str, keys: list[str], block_rows: int) -> DataFrame:
    """Rows of equal ``keys`` in arrays of about ``block_rows`` (id and vec, by id), dealt by a hash of the id:
    keys, <key>_block and <key>_rows."""
    shape = rows.select(F.col(key).alias("id"), *keys, "vec")
    sizes = shape.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("blocks"))
    placed = shape.join(sizes, keys).withColumn(f"{key}_block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return placed.groupBy(*keys, f"{key}_block").agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias(f"{key}_rows"))


def best_of_blocks(met: DataFrame, k: int) -> DataFrame:
    """The k best rows of id_rows for each query of qid_rows, block by block: qid, id, score."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                (i, x), (j, y) = unit(batch.column(0)[at]), unit(batch.column(1)[at])
                scores = np.round(x @ y.T, 6)
                scores[i[:, None] == j[None, :]] = -np.inf
                # Rows are in order of id, and a stable sort keeps that among equal scores.
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(scores, best, 1).ravel()
                kept = found > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, best.shape[1])[kept]), pa.array(j[best.ravel()][kept]), pa.array(found[kept])], ["qid", "id", "score"])

    return map_arrow(met.select("qid_rows", "id_rows"), run, "qid long, id long, score double")


def nearest_by_blocks(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k neighbours of many queries (qid, space_id, vec), exactly, by score then id: qid, id, score, rank.

    Every query meets every row of its space and dimension but the one with its own id. A block of
    queries against a block of rows is one matrix product in a task, from which the k best come out.
    """
    keys = ["space_id", "dim"]
    sided = lambda rows, key: blocks_of(rows.withColumn("dim", F.size("vec")), key, keys, block_rows)
    # Pairs of blocks are dealt to tasks by both, so that one space does not end in one task.
    met = sided(queries, "qid").join(sided(vectors, "id"), keys).repartition(*keys, "qid_block", "id_block")
    return ranked_best(best_of_blocks(met, k), k)


def ranked_best(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def overlay(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Base vectors with a journal (id, space_id, vec, seq, op) on top: the last entry of a key wins."""
    last = delta.withColumn("_n", F.row_number().over(Window.partitionBy("id", "space_id").orderBy(F.desc("seq")))).where("_n = 1")
    kept = base.join(last.select("id", "space_id"), ["id", "space_id"], "left_anti")
    return kept.unionByName(last.where("op = 'upsert'").select(*base.columns))


def seeded(vectors: DataFrame, seeds: DataFrame, cap: int = SEMANTIC_CAP) -> DataFrame:
    """Vectors by their best cosine to the seeds (at most SEED_CAP ids) of the same space, seeds left out."""
    few = F.broadcast(vectors.join(F.broadcast(seeds.select("id").limit(SEED_CAP)), "id", "left_semi").select("space_id", F.col("id").alias("seed"), F.col("vec").alias("s")))
    scored = vectors.join(few, "space_id").join(F.broadcast(seeds.select("id").limit(SEED_CAP)), "id", "left_anti")
    best = scored.groupBy("id").agg(F.max(F.round(cosine(F.col("vec"), F.col("s")), 6)).alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(cap)


def with_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows numbered from zero; for lists already cut to a few hundred."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def hybrid_lists(words: DataFrame, vectors_of: DataFrame, wanted: list[float] | None, space: str, mode: str) -> list[tuple[DataFrame, float]]:
    """The ranked lists (id, rank) of a hybrid search with their weights: word hits, neighbours of the text's
    vector, and neighbours of the first word hits. Without a vector words stand alone.

    words is read several times, so it is best a table that is at hand (see settled). Only what
    words and vectors_of hold takes part: a caller restricts both to what may be seen."""
    weights = FUSION[mode]
    lists = [(words, weights[0])]
    if wanted is not None:
        near = nearest(vectors_of, checked_vector(vectors_of, space, wanted), SEMANTIC_CAP, space)
        seeds = seeded(vectors_of, words.where(F.col("rank") < SEED_CAP))
        lists += [(with_rank(rows, F.desc("score"), F.col("id")).select("id", "rank"), w) for rows, w in zip((near, seeds), weights[1:])]
    return lists


def delta_window(state: DataFrame, delta: DataFrame, cap: int) -> DataFrame:
    """The one row of an index's state beside each of its newest journal entries (at most ``cap``), or
    beside nulls: one read of both, which an overlay needs to fit together."""
    newest = delta.where(F.col("seq") > state.first()["generation"]).orderBy(F.desc("seq")).limit(cap)
    return newest.join(F.broadcast(state), how="right")


def fused(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank from zero)."""
    parts = [rows.select("id", (F.lit(weight) / (F.lit(RRF_K) + F.col("rank") + 1)).alias("part")) for rows, weight in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.round(F.sum("part"), 9).alias("score"))


def paired_blocks(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Each pair of blocks of a space and dimension once: rows, more (arrays of id and vec), and same."""
    shape = vectors.withColumn("dim", F.size("vec"))
    sizes = shape.groupBy("space_id", "dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("blocks"))
    placed = shape.join(sizes, ["space_id", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = placed.groupBy("space_id", "dim", "blocks", "block").agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("rows"))
    # Block i meets i, i + 1, ... so that each pair of blocks meets once.
    left = blocks.withColumn("other", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> x)"))).where("other >= block")
    met = left.join(blocks.select("space_id", "dim", F.col("block").alias("other"), F.col("rows").alias("more")), ["space_id", "dim", "other"])
    return met.select("rows", "more", (F.col("block") == F.col("other")).alias("same"))


def close_places(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of x and y with a cosine of at least ``least``, for a strip of x at a time."""
    for at in range(0, len(x), 256):
        a, b = np.nonzero(x[at : at + 256] @ y.T >= least - 1e-9)
        yield a + at, b


def close_pairs(vectors: DataFrame, least: float = NEAR_COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs (a < b) of one space and dimension with a cosine of at least ``least``, exactly.

    Vectors are cut into blocks; each pair of blocks is one matrix product in a task, from which only
    the close pairs come out.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (i, x), (j, y), same = unit(batch.column(0)[k]), unit(batch.column(1)[k]), batch.column(2)[k].as_py()
                for a, b in close_places(x, y, least):
                    keep = i[a] < j[b] if same else i[a] != j[b]
                    one, two = i[a][keep], j[b][keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    return map_arrow(paired_blocks(vectors, block_rows), run, "a long, b long").distinct()


def window_pairs(vectors: DataFrame, after: tuple[str, int] | None, rows: int = 2000, least: float = NEAR_COSINE) -> DataFrame:
    """Close pairs (a, b) within one window of rows in order of space and id, behind the last one seen, and
    ``partial``: whether more rows follow, whose pairs with the window's are not here."""
    ahead = vectors if after is None else vectors.where(F.struct("space_id", "id") > F.struct(F.lit(after[0]).alias("space_id"), F.lit(after[1]).cast("long").alias("id")))
    window = settled(ahead.orderBy("space_id", "id").limit(rows + 1))
    partial = window.count() > rows
    return close_pairs(window.orderBy("space_id", "id").limit(rows), least).withColumn("partial", F.lit(partial))


def unit(block: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a block; vectors without a norm are zero."""
    rows = block.values
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    x = rows.field("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return ids, np.where(norms**2 > EPSILON, x / np.maximum(norms, 1e-30), 0.0)


def links_of_block(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, least id reached) that connect what the close pairs of two blocks connect, one per id at most."""
    ids, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    p, q = place[: len(i)], place[len(i) :]
    label = np.arange(len(ids))
    for a, b in close_places(x, y, least):
        a, b = p[a], q[b]
        while (label[a] != label[b]).any():
            low = np.minimum(label[a], label[b])
            new = label.copy()
            # The labels themselves move too, so that a strip joins what earlier strips have linked.
            for at in (a, b, label[a], label[b]):
                np.minimum.at(new, at, low)
            while (new != new[new]).any():
                new = new[new]
            label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def near_links(vectors: DataFrame, least: float = NEAR_COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that connect exactly the ids which close_pairs connects, without listing its pairs.

    Equal vectors of a space are one class: members are tied to the least id, and only that is compared,
    by products of blocks as in close_pairs. A pair of blocks gives one link per id at most, so that
    rows grow with the number of ids and blocks and not with the square of a group. A class with over a
    thousandth of all rows is broadcast, since one key must not hold many rows of a join.
    """
    copies, heads = copy_classes(vectors, least)
    return copies.unionByName(block_links(paired_blocks(heads, block_rows), least)).distinct()


def copy_classes(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) from the copies of a vector to the least id among them, and those heads (id, space_id, vec)."""
    rows = vectors.select("id", "space_id", "vec")
    classes = rows.groupBy("space_id", "vec").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"))
    total = rows.count()
    again = classes.where((F.col("n") > 1) & (cosine(F.col("vec"), F.col("vec")) >= least - 1e-9)).select("space_id", "vec", "head", "n")
    heavy = F.broadcast(again.where(F.col("n") * 1000 > total).drop("n"))
    light = again.where(F.col("n") * 1000 <= total).drop("n")
    few = rows.join(heavy, ["space_id", "vec"], "left_anti")
    copies = rows.join(heavy, ["space_id", "vec"]).unionByName(few.join(light, ["space_id", "vec"])).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    return copies, classes.select(F.col("head").alias("id"), "space_id", "vec")


def block_links(met: DataFrame, least: float) -> DataFrame:
    """Links (a, b) within pairs of blocks (rows, more), one per id and pair of blocks at most."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = links_of_block(*unit(batch.column(0)[k]), *unit(batch.column(1)[k]), least)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return map_arrow(met.select("rows", "more"), run, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """id and the least id that it reaches over the pairs (root); ids without a pair are not listed.

    Labels spread to neighbours and then along labels, so rounds grow with the logarithm of a chain.
    Each round is written to the shared checkpoint folder and read again: a checkpoint would keep the
    plan's size estimates, whose digits multiply with every join until the driver's memory is full.
    """
    both = settled(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("root", "near").alias("root"))
        jumped = settled(spread.join(spread.select(F.col("id").alias("root"), F.col("root").alias("up")), "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root")))
        moved = jumped.join(labels.withColumnRenamed("root", "old"), "id").where("root <> old")
        done, old, labels = moved.isEmpty(), labels, jumped
        removed(pairs.sparkSession, *{f.rpartition("/")[0] for f in old.inputFiles()})
        if done:
            return labels


def near_members(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per id that is near another: space_id, id and root, the least id of its component."""
    return components(pairs).join(vectors.select("id", "space_id"), "id").select("space_id", "id", "root")


def near_groups(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components of two or more: space_id, root, n, and an id for reviews made of the space and the members.

    The id takes the members' hashes in any order, so no group is brought together in one place.
    """
    return groups_of(near_members(vectors, pairs))


def groups_of(members: DataFrame) -> DataFrame:
    """near_groups of members (space_id, id, root)."""
    share = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10).cast("long")
    groups = members.groupBy("space_id", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(share).alias("mark"))
    return groups.select("space_id", "root", "n", F.concat(F.lit("near:"), F.sha2(F.concat_ws("|", "space_id", F.col("n").cast("string"), F.col("mark").cast("string")), 256)).alias("review_id"))
