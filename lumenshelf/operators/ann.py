"""A kept vector index: rows stored by cell, generations with a journal on top, searches that read few cells.

Cells are fitted on a bounded sample; every row is stored in the cell whose centre is nearest. A search reads
the cells nearest to its vector. The widest angle of each cell is kept too: it tells which of the other cells can
hold a better row, so that a search can be made exact, and which cells two close rows can lie in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenshelf.functions.storage import Versions, settled, shared_folder
from lumenshelf.functions.workers import in_parts, map_arrow
from lumenshelf.operators import vectors as V

#: Rows of a space that its cells are fitted on (expected number), and the most cells of a space. Centres
#: and angles travel with tasks: 4096 cells of 1024 dimensions take 32 MB.
FIT_ROWS, MAX_CELLS, FIT_ROUNDS = 20_000, 4096, 8
#: Journal entries from which the index is written anew, as a new generation.
COMPACT_AT = 256
#: Cells that a search reads unless told otherwise, and queries on which that number is tuned.
PROBES, TUNE_QUERIES = 8, 200
#: Rows that are compared with all centres at once: 4096 of these take 32 MB.
PART_ROWS = 1024
#: Groups of cells that close pairs meet in, as long as a block's vectors take no more bytes than this.
GROUPS, BLOCK_BYTES = 8, 8 << 20
#: Scores are rounded to six places, and angles a little off count as met.
SLACK = 2e-6
ROWS = "id long, space_id string, vec array<double>"


@dataclass
class Cells:
    """The cells of all spaces, numbered through: space, centre (a unit vector, or zero for rows without a
    norm) and the least cosine of a row to its centre."""

    spaces: list[str]
    centres: list[np.ndarray]
    least: np.ndarray

    def of(self, space: str, dim: int) -> np.ndarray:
        return np.array([k for k, s in enumerate(self.spaces) if s == space and len(self.centres[k]) == dim], np.int64)

    def reach(self, places: np.ndarray, cosines: np.ndarray, beyond: float = 0.0) -> np.ndarray:
        """The greatest cosine that a row of each cell can have to vectors with these cosines to its centre;
        with ``beyond``, to what lies within that angle of the vectors."""
        zero = np.array([not self.centres[p].any() for p in places])
        angle = np.arccos(np.clip(cosines, -1, 1)) - np.arccos(np.clip(self.least[places], -1, 1)) - beyond
        return np.where(zero, 0.0, np.cos(np.clip(angle, 0, np.pi)))


def fitted(rows: DataFrame, cells_wanted: int | None = None) -> Cells:
    """Cells for each space and dimension, about the square root of their rows, by k-means on a sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    kinds = rows.groupBy("space_id", F.size("vec").alias("dim")).count().orderBy("space_id", "dim").collect()
    spaces, centres = [], []
    for space, dim, n in kinds:
        mine = rows.where((F.col("space_id") == space) & (F.size("vec") == dim))
        k = min(cells_wanted or max(1, round(n**0.5)), MAX_CELLS)
        sample = mine.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, FIT_ROWS / n) * (1 << 20)) + 1)
        sample = sample.where(V.dot(F.col("vec"), F.col("vec")) > V.EPSILON).select(array_to_vector(F.col("vec")).alias("features")).cache()
        found = []
        if dim and not sample.isEmpty():
            model = KMeans(k=max(k, 2), seed=1, maxIter=FIT_ROUNDS, distanceMeasure="cosine").fit(sample)
            found = [np.asarray(c) / max(np.linalg.norm(c), 1e-30) for c in model.clusterCenters()]
        sample.unpersist()
        for centre in [*found, np.zeros(dim)]:
            spaces.append(space)
            centres.append(centre)
    return Cells(spaces, centres, np.ones(len(centres)))


def placed(rows: DataFrame, cells: Cells) -> DataFrame:
    """rows (id, space_id, vec) with the cell of each and its cosine to the centre."""

    def run(batches):
        for batch in in_parts(batches, PART_ROWS):
            cell, cosine = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for picked, places, x in by_kind(batch, cells):
                scores = x @ np.stack([cells.centres[p] for p in places]).T
                none = ~x.any(axis=1)
                scores[none, -1] = np.inf  # the last cell of a kind is for rows without a norm
                scores[~none, -1] = -np.inf
                best = scores.argmax(axis=1)
                cell[picked] = places[best]
                cosine[picked] = np.where(none, 1.0, scores[np.arange(len(best)), best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(cosine)], ["id", "space_id", "vec", "cell", "cosine"])

    return map_arrow(rows.selectExpr("CAST(id AS LONG) AS id", "space_id", "CAST(vec AS ARRAY<DOUBLE>) AS vec"), run, f"{ROWS}, cell int, cosine double")


def by_kind(batch: pa.RecordBatch, cells: Cells):
    """Rows of a batch (id, space_id, vec, ...) by space and dimension: their places, the cells, unit vectors."""
    spaces, lengths = np.array(batch.column(1).to_pylist(), object), np.diff(batch.column(2).offsets.to_numpy())
    for space, dim in sorted(set(zip(spaces.tolist(), lengths.tolist())), key=str):
        picked, places = np.flatnonzero((spaces == space) & (lengths == dim)), cells.of(space, dim)
        if len(places):
            x = batch.column(2).take(pa.array(picked)).flatten().to_numpy(zero_copy_only=False).reshape(len(picked), dim)
            norms = np.linalg.norm(x, axis=1, keepdims=True)
            yield picked, places, np.where(norms**2 > V.EPSILON, x / np.maximum(norms, 1e-30), 0.0)


def probes_of(queries: DataFrame, cells: Cells, probes: int, skip: int = 0) -> DataFrame:
    """The cells that each query reads: qid, cell, vec.

    The ``probes`` nearest, or with ``skip`` those behind the first ``skip`` that can hold a row at
    least as near as the query's ``kth`` score so far.
    """

    def run(batches):
        for batch in in_parts(batches, PART_ROWS):
            for picked, places, x in by_kind(batch, cells):
                cosines = x @ np.stack([cells.centres[p] for p in places]).T
                order = np.argsort(-cosines, axis=1, kind="stable")
                chosen = np.zeros(cosines.shape, bool)
                np.put_along_axis(chosen, order[:, :skip] if skip else order[:, :probes], True, 1)
                if skip:
                    kth = batch.column(3).take(pa.array(picked)).to_numpy(zero_copy_only=False)
                    chosen = ~chosen & (cells.reach(places, cosines) >= kth[:, None] - SLACK)
                at, cell = np.nonzero(chosen)
                rows = pa.array(picked[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(places[cell].astype(np.int32)), batch.column(2).take(rows)], ["qid", "cell", "vec"])

    wanted = ["qid", "space_id", "vec"] + (["kth"] if skip else [])
    return map_arrow(queries.withColumn("vec", F.col("vec").cast("array<double>")).select(*wanted), run, "qid long, cell int, vec array<double>")


@dataclass
class Snapshot:
    """One generation of an index as a reader sees it: what later writers do changes nothing here."""

    spark: SparkSession
    folder: str
    manifest: dict
    cells: Cells

    def journal(self) -> DataFrame:
        """The last entry of each key in the journal: id, space_id, vec, cell, op. It has fewer than COMPACT_AT rows."""
        parts = [self.spark.read.parquet(f"{self.folder}/{p}") for p in self.manifest["journal"]]
        schema = f"{ROWS}, cell int, op string, entry long"
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
        last = Window.partitionBy("id", "space_id").orderBy(F.desc("entry"))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("id", "space_id", "vec", "cell", "op")

    def rows(self) -> DataFrame:
        """All rows as of this generation: id, space_id, vec, cell."""
        base = self.spark.read.parquet(f"{self.folder}/{self.manifest['base']}").select("id", "space_id", "vec", "cell")
        if not self.manifest["journal"]:
            return base
        journal = F.broadcast(self.journal())
        return base.join(journal.select("id", "space_id"), ["id", "space_id"], "left_anti").unionByName(journal.where("op = 'upsert'").drop("op"))

    def nearest(self, vector: list[float], k: int, space: str, probes: int = PROBES) -> DataFrame:
        """The k best rows of the cells nearest to one vector, by exact score then id. Only those cells' folders are read."""
        x = np.array(vector, float)
        places = self.cells.of(space, len(x))
        if not len(places):
            return V.nearest(self.rows().where(F.lit(False)), [0.0], k)
        cosines = np.stack([self.cells.centres[p] for p in places]) @ x
        near = places[np.argsort(-cosines, kind="stable")[:probes]].tolist()
        return V.nearest(self.rows().where(F.col("cell").isin(near)), vector, k, space)

    def search(self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """The k neighbours of many queries (qid, space_id, vec) by score then id: qid, id, score, rank.

        Queries meet the rows of their nearest cells, in blocks, so that neither a cell nor its queries
        need fit one task. With ``exact`` the k-th score of each then tells which further cells can hold a
        better row, and those are read too: nothing is missed, and on vectors without any structure all is read.
        """
        first = settled(self.met(probes_of(queries, self.cells, probes), k))
        if not exact:
            return V.ranked_best(first, k)
        kth = V.ranked_best(first, k).where(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
        open_ = queries.join(kth, "qid", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
        return V.ranked_best(first.unionByName(self.met(probes_of(open_, self.cells, probes, skip=probes), k)), k)

    def met(self, probed: DataFrame, k: int, block_rows: int = V.BLOCK_ROWS) -> DataFrame:
        sided = lambda rows, key: V.blocks_of(rows, key, ["cell"], block_rows)
        pairs = sided(probed, "qid").join(sided(self.rows(), "id"), "cell").repartition("cell", "qid_block", "id_block")
        return V.best_of_blocks(pairs, k)

    def tuned(self, k: int, recall: float = 0.95, queries: int = TUNE_QUERIES) -> int:
        """The fewest probes, doubled from one, with which a bounded sample of rows finds this share of its neighbours."""
        n = max(self.rows().count(), 1)
        sample = settled(self.rows().where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(min(1.0, queries / n) * (1 << 20)) + 1).limit(4 * queries).select(F.col("id").alias("qid"), "space_id", "vec"))
        truth = settled(V.nearest_by_blocks(self.rows().select("id", "space_id", "vec"), sample, k).select("qid", "id"))
        all_, probes = max(truth.count(), 1), 1
        while probes < len(self.cells.spaces):
            if self.search(sample, k, probes).join(truth, ["qid", "id"]).count() >= recall * all_:
                return probes
            probes *= 2
        return len(self.cells.spaces)


class VectorIndex:
    """The writer's side: a base and journal files under one manifest, in a folder that all share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def snapshot(self, number: int | None = None) -> Snapshot:
        manifest = self.versions.read(number) if number else self.versions.latest()
        if manifest is None:
            raise ValueError("the index has no generation yet")
        rows = self.spark.read.parquet(self.versions.at(manifest["cells"])).orderBy("cell").collect()
        cells = Cells([r["space_id"] for r in rows], [np.array(r["centre"]) for r in rows], np.array([r["least"] for r in rows]))
        return Snapshot(self.spark, self.versions.folder, manifest, cells)

    def build(self, rows: DataFrame, cells_wanted: int | None = None) -> Snapshot:
        """A first or fresh generation from whole rows (id, space_id, vec), each once."""
        latest = self.versions.latest()
        return self.written(rows, fitted(rows, cells_wanted), latest["number"] if latest else 0, 0)

    def written(self, rows: DataFrame, cells: Cells, after: int, entry: int) -> Snapshot:
        """Rows as the base of the generation that follows ``after``: a folder per cell, large cells in several files."""
        base, told = self.versions.part("base"), self.versions.part("cells")
        parts = max(1, self.spark.sparkContext.defaultParallelism)
        spread = F.pmod(F.xxhash64("id"), F.lit(4))
        placed(rows, cells).repartition(parts, "cell", spread).write.partitionBy("cell").parquet(self.versions.at(base))
        kept = self.spark.read.schema(f"{ROWS}, cosine double, cell int").parquet(self.versions.at(base))
        for r in kept.groupBy("cell").agg(F.min("cosine").alias("least")).where("cell >= 0").collect():
            cells.least[r["cell"]] = r["least"]
        table = [(k, s, c.tolist(), float(x)) for k, (s, c, x) in enumerate(zip(cells.spaces, cells.centres, cells.least))]
        self.spark.createDataFrame(table, "cell int, space_id string, centre array<double>, least double").coalesce(1).write.parquet(self.versions.at(told))
        manifest = {"base": base, "cells": told, "journal": [], "entries": 0, "entry": entry, "fitted_on": kept.count()}
        self.versions.publish(manifest, after)
        return self.snapshot()

    def apply(self, changes: DataFrame) -> Snapshot:
        """Append changes (id, space_id, vec, op: upsert or delete) to the journal, in one version.

        Of changes to one key in a batch the last by ``seq`` counts, if there is such a column. Once the journal
        has COMPACT_AT entries, the rows are written anew without it, and cells are fitted anew
        when the rows have doubled since.
        """
        manifest = self.versions.latest()
        ordered = changes if "seq" in changes.columns else changes.withColumn("seq", F.lit(0))
        last = Window.partitionBy("id", "space_id").orderBy(F.desc("seq"))
        once = ordered.withColumn("_n", F.row_number().over(last)).where("_n = 1")
        snapshot, part = self.snapshot(manifest["number"]), self.versions.part("journal")
        vec = F.when(F.col("op") == "upsert", F.col("vec").cast("array<double>")).otherwise(F.array().cast("array<double>"))
        cells = placed(once.withColumn("vec", vec), snapshot.cells).select("id", "space_id", "vec", "cell")
        rows = cells.join(once.select("id", "space_id", "op"), ["id", "space_id"]).withColumn("entry", F.lit(manifest["entry"] + 1).cast("long"))
        rows.write.parquet(self.versions.at(part))
        n = self.spark.read.parquet(self.versions.at(part)).count()
        entry = manifest["entry"] + 1
        told = manifest | {"journal": [*manifest["journal"], part], "entries": manifest["entries"] + n, "entry": entry}
        # A row of a kind that the cells do not know, or beyond the angle of its cell, makes them wrong.
        fits = rows.where("op = 'upsert'").select("cell").where("cell < 0").isEmpty()
        if told["entries"] < COMPACT_AT and fits:
            told = self.widened(told, snapshot, part)
            self.versions.publish(told, manifest["number"])
            return self.snapshot()
        now = Snapshot(self.spark, self.versions.folder, told, snapshot.cells).rows().select("id", "space_id", "vec")
        grown = now.count()
        refit = not fits or grown > 2 * manifest["fitted_on"]
        return self.written(now, fitted(now) if refit else snapshot.cells, manifest["number"], entry)

    def widened(self, told: dict, snapshot: Snapshot, part: str) -> dict:
        """The manifest with cells whose angle takes in the journal's new rows."""
        rows = self.spark.read.parquet(self.versions.at(part)).where("op = 'upsert'").select("id", "space_id", "vec")
        least = {r["cell"]: r["least"] for r in placed(rows, snapshot.cells).groupBy("cell").agg(F.min("cosine").alias("least")).collect()}
        cells = snapshot.cells
        if all(cells.least[k] <= x for k, x in least.items()):
            return told
        name = self.versions.part("cells")
        table = [(k, s, c.tolist(), float(min(x, least.get(k, 1.0)))) for k, (s, c, x) in enumerate(zip(cells.spaces, cells.centres, cells.least))]
        self.spark.createDataFrame(table, "cell int, space_id string, centre array<double>, least double").coalesce(1).write.parquet(self.versions.at(name))
        return told | {"cells": name}


def fresh_index(spark: SparkSession) -> VectorIndex:
    """An index in a new folder beside the other intermediate tables."""
    import uuid

    return VectorIndex(spark, f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}")


# --- joins of all close pairs through cells ------------------------------------------------------------


def neighbourhoods(rows: DataFrame, cells: Cells, block_rows: int | None = None) -> tuple[np.ndarray, int]:
    """The group of each cell, and the rows of a block: cells of a space along the main axis of their centres, until a
    block is full. A row is sent once to a group, however many of its cells it visits: vectors without structure are
    moved as often as there are groups, not cells."""
    counts, size = np.zeros(len(cells.spaces), np.int64), np.array([len(c) for c in cells.centres])
    for r in rows.where("cell >= 0").groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    kinds = [cells.of(s, d) for s, d in sorted({(s, int(d)) for s, d in zip(cells.spaces, size)}, key=str)]
    if block_rows is None:
        most = max((int(counts[k].sum()) for k in kinds), default=0)
        block_rows = max(64, min(max(V.BLOCK_ROWS, most // GROUPS), BLOCK_BYTES // (8 * max(1, *size, 1))))
    groups, at = np.full(len(counts), -1, np.int64), 0
    for places in kinds:
        centres = np.stack([cells.centres[p] for p in places])
        axis = np.linalg.svd(centres, full_matrices=False)[2][0] if centres.shape[1] else np.zeros(0)
        held = 0
        for p in places[np.argsort(centres @ axis, kind="stable")]:
            if held and held + counts[p] > block_rows:
                at, held = at + 1, 0
            groups[p], held = at, held + counts[p]
        at += 1
    return groups, block_rows


def visits(rows: DataFrame, cells: Cells, least: float, groups: np.ndarray) -> DataFrame:
    """The groups of cells beyond its own that each placed row (id, space_id, vec, cell) can have a partner in, in
    a cell of a greater number: id, vec, group.

    A partner lies within the threshold's angle. So the row's angle to the other centre is at most the
    cell's widest and that together, and since the partner is nearer to that centre than to the row's
    own, the row is at most the threshold's angle off the plane between the two.
    """
    angle = float(np.arccos(least)) + 1e-6

    def run(batches):
        for batch in batches:
            homes = batch.column(3).to_numpy()
            for picked, places, x in by_kind(batch, cells):
                centres = np.stack([cells.centres[p] for p in places])
                for at in range(0, len(picked), 1024):
                    part, home = x[at : at + 1024], homes[picked[at : at + 1024]]
                    cosines = part @ centres.T
                    near = cells.reach(places, cosines, angle) >= 1 - SLACK
                    own = np.searchsorted(places, home)
                    apart = centres @ centres.T
                    width = np.sqrt(np.maximum(2 - 2 * apart[own], 1e-12))
                    # Off the plane between the centres by no more than the angle.
                    near &= (cosines[np.arange(len(own)), own][:, None] - cosines) / width <= np.sin(min(angle, np.pi / 2)) + SLACK
                    near &= (places[None, :] > home[:, None]) & part.any(axis=1)[:, None] & centres.any(axis=1)[None, :]
                    i, j = np.nonzero(near)
                    found = np.unique(np.stack([i, groups[places[j]]]), axis=1)
                    i, group = found[:, found[1] != groups[home[found[0]]]]
                    of = pa.array(picked[at : at + 1024][i])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), pa.array(group)], ["id", "vec", "group"])

    return map_arrow(rows.select("id", "space_id", "vec", "cell"), run, "id long, vec array<double>, group long")


def cell_meetings(rows: DataFrame, cells: Cells, least: float, block_rows: int | None = None) -> DataFrame:
    """Pairs of blocks in which all close pairs of placed rows meet: rows, more and same, as in vectors.paired_blocks."""
    groups, block_rows = neighbourhoods(rows, cells, block_rows)
    group = F.element_at(F.array(*[F.lit(int(g)) for g in groups]), F.col("cell") + 1).cast("long")
    homes = settled(V.blocks_of(rows.where("cell >= 0").withColumn("group", group), "id", ["group"], block_rows).withColumnsRenamed({"id_block": "block", "id_rows": "rows"}))
    guests = V.blocks_of(visits(rows, cells, least, groups), "id", ["group"], block_rows).withColumnsRenamed({"id_block": "other", "id_rows": "more"})
    within = homes.join(homes.select("group", F.col("block").alias("other"), F.col("rows").alias("more")), "group").where("other >= block")
    across = homes.join(guests, "group")
    return within.select("group", "block", "other", "rows", "more", (F.col("block") == F.col("other")).alias("same")).unionByName(across.select("group", "block", "other", "rows", "more", F.lit(False).alias("same"))).repartition("group", "block", "other", "same").select("rows", "more", "same")


def near_links(vectors: DataFrame, least: float = V.NEAR_COSINE, cells_wanted: int | None = None) -> DataFrame:
    """Links (a, b) that connect exactly what vectors.near_links connects, through cells.

    Copies are tied to the least id; of the rest each row meets the rows of its own cell and of those that can
    hold a partner. How few these are is up to the vectors: clusters narrower than the threshold's angle are met
    once, vectors spread evenly over many dimensions still all meet.
    """
    copies, heads = V.copy_classes(vectors, least)
    heads = settled(heads)
    cells = fitted(heads, cells_wanted)
    rows = settled(placed(heads, cells))
    for r in rows.where("cell >= 0").groupBy("cell").agg(F.min("cosine").alias("least")).collect():
        cells.least[r["cell"]] = r["least"]
    return copies.unionByName(V.block_links(cell_meetings(rows, cells, least), least)).distinct()


def comparisons(met: DataFrame) -> int:
    """Pairs of rows that meet."""
    return met.agg(F.sum(F.when(F.col("same"), F.size("rows") * (F.size("rows") - 1) / 2).otherwise(F.size("rows") * F.size("more")))).first()[0] or 0
