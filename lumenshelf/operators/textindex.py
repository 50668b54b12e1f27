"""A kept text index: segments of postings with tombstones, statistics by deltas, and three-letter grams of names."""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenshelf.functions import text as T
from lumenshelf.functions.storage import Versions, removed, shared_folder
from lumenshelf.operators import search

#: A segment is merged with the one before it until that is this many times larger.
TIER = 4
#: Tombstones that are sent to every task; more are joined by shuffle.
MAX_BROADCAST_ROWS = 200_000
GRAM = 3


def grams_of(name: Column) -> Column:
    """Distinct runs of three characters of a folded name."""
    folded = T.fold(name)
    starts = F.sequence(F.lit(1), F.char_length(folded) - (GRAM - 1))
    return F.when(F.char_length(folded) >= GRAM, F.array_distinct(F.transform(starts, lambda k: F.substring(folded, k, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


class TextSnapshot:
    """One version of an index as a reader sees it."""

    def __init__(self, spark: SparkSession, folder: str, manifest: dict):
        self.spark, self.folder, self.manifest = spark, folder, manifest

    def table(self, kind: str) -> DataFrame:
        """The live rows of all segments: terms, rows or grams. What a later segment replaced or deleted is not among them."""
        return alive(self.spark, self.folder, self.manifest, kind, self.manifest["segments"])

    def hits(self, text: str) -> DataFrame:
        """What search.hits finds (id, name, rank, tier), from ranges of terms and grams alone."""
        rows, groups = self.table("rows"), T.query_groups(text)
        words = rows.select("id", "name", F.lit(0.0).alias("rank"), F.lit(0).alias("tier")).where(F.lit(False))
        if groups:
            words = search.ranked_by_postings(self.table("terms"), rows, groups, self.manifest["n"], self.manifest["length"])
        rest = self.substring_hits(text).join(words.select("id"), "id", "left_anti")
        return words.unionByName(rest.select("id", "name", F.lit(search.SUBSTRING_RANK).alias("rank"), F.lit(2).alias("tier")))

    def search(self, text: str, limit: int = 100, keep: DataFrame | None = None) -> DataFrame:
        found = self.hits(text)
        return (found if keep is None else found.join(keep.select("id"), "id", "left_semi")).orderBy(*search.relevance()).limit(limit)

    def substring_hits(self, text: str) -> DataFrame:
        """Names (id, name) that contain the text of three characters or more: those that have all of its
        grams, looked at once more."""
        rows = self.table("rows").select("id", "name")
        folded = self.spark.range(1).select(T.fold(F.lit(text))).first()[0]
        grams = sorted({folded[k : k + GRAM] for k in range(len(folded) - GRAM + 1)})
        if len(text) < GRAM or not grams:
            return rows.where(F.lit(False))
        having = self.table("grams").where(F.col("gram").isin(grams)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
        return rows.join(having.select("id"), "id", "left_semi").where(T.fold(F.col("name")).contains(folded))


def alive(spark: SparkSession, folder: str, manifest: dict, kind: str, segments: list[dict]) -> DataFrame:
    parts = [spark.read.parquet(f"{folder}/{s[kind]}").withColumn("segment", F.lit(s["at"])) for s in segments]
    rows = reduce(DataFrame.unionByName, parts)
    oldest = min(s["at"] for s in segments)
    dead = [d for d in manifest["dead"] if d["at"] > oldest]
    if not dead:
        return rows.drop("segment")
    gone = reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/{d['ids']}").withColumn("dead_at", F.lit(d["at"])) for d in dead])
    gone = gone.groupBy("id").agg(F.max("dead_at").alias("dead_at"))
    gone = F.broadcast(gone) if sum(d["n"] for d in dead) <= MAX_BROADCAST_ROWS else gone
    return rows.join(gone, "id", "left").where("dead_at IS NULL OR segment >= dead_at").drop("segment", "dead_at")


class TextIndex:
    """The writer's side. Each batch of edits is one version: a segment of the new rows, and tombstones for
    the ids it replaces or deletes. The number of rows and their total length are kept up by differences."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def snapshot(self, number: int | None = None) -> TextSnapshot:
        manifest = self.versions.read(number) if number else self.versions.latest()
        if manifest is None:
            raise ValueError("the index has no version yet")
        return TextSnapshot(self.spark, self.versions.folder, manifest)

    def build(self, rows: DataFrame) -> TextSnapshot:
        """An index of search rows (as search.search_rows), each id once."""
        latest = self.versions.latest()
        segment, length = self.indexed(rows, 1)
        self.versions.publish({"segments": [segment], "dead": [], "n": segment["n"], "length": length, "at": 1}, latest["number"] if latest else 0)
        return self.snapshot()

    def indexed(self, rows: DataFrame, at: int) -> tuple[dict, int]:
        """A segment of search rows. What postings wrote goes once the segment is there."""
        terms, kept = search.postings(rows)
        found = self.segment(terms, kept, at)
        removed(self.spark, *{f.rpartition("/")[0] for f in kept.inputFiles()})
        return found

    def segment(self, terms: DataFrame, rows: DataFrame, at: int) -> tuple[dict, int]:
        """Write postings and rows as a segment, and tell how long the rows are together."""
        names = {kind: self.versions.part(kind) for kind in ("terms", "rows", "grams")}

        def write(table: DataFrame, kind: str, *order: str) -> None:
            search.write_in_order(table, self.versions.at(names[kind]), *order)

        write(rows, "rows", "id")
        kept = self.spark.read.parquet(self.versions.at(names["rows"]))
        write(terms, "terms", "term", "id")
        write(kept.select("id", F.explode(grams_of(F.col("name"))).alias("gram")), "grams", "gram", "id")
        n, length = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return names | {"at": at, "n": n}, length

    def apply(self, rows: DataFrame, deleted: DataFrame) -> TextSnapshot:
        """One batch of edits: search rows that are new or changed, each id once, and the ids (id) that go.
        An id that is in both stays, with its new row."""
        manifest = self.versions.latest()
        at, number = manifest["at"] + 1, manifest["number"]
        added, length = self.indexed(rows, at)
        ids = self.spark.read.parquet(self.versions.at(added["rows"])).select("id").unionByName(deleted.select("id")).distinct()
        dead = self.versions.part("dead")
        ids.write.parquet(self.versions.at(dead))
        gone = self.spark.read.parquet(self.versions.at(dead))
        n_gone = gone.count()
        hint = F.broadcast(gone) if n_gone <= MAX_BROADCAST_ROWS else gone
        old = self.snapshot(number).table("rows").join(hint, "id", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        told = manifest | {"segments": [*manifest["segments"], added], "dead": [*manifest["dead"], {"ids": dead, "at": at, "n": n_gone}], "at": at}
        told |= {"n": manifest["n"] - old[0] + added["n"], "length": manifest["length"] - old[1] + length}
        self.versions.publish(self.merged(told), number)
        return self.snapshot()

    def merged(self, manifest: dict) -> dict:
        """The manifest with its youngest segments made one as long as they are of like size. Tombstones that
        no older segment needs leave with them."""
        segments = list(manifest["segments"])
        young = 1
        while young < len(segments) and segments[-young - 1]["n"] < TIER * max(sum(s["n"] for s in segments[-young:]), 1):
            young += 1
        if young == 1:
            return manifest
        of = lambda kind: alive(self.spark, self.versions.folder, manifest, kind, segments[-young:])
        one, _ = self.segment(of("terms"), of("rows"), manifest["at"])
        # A merged segment is as young as its youngest part; what was dead before it was left out.
        kept = segments[:-young]
        dead = [d for d in manifest["dead"] if kept]
        return manifest | {"segments": [*kept, one], "dead": dead}


def kept_index(cat) -> TextIndex:
    """The index of a catalogue's search rows: built at first use, and again when a table it reads has changed."""
    name = sha256(stamp_of(cat.spark, cat.sf_dir).encode()).hexdigest()[:24]
    index = TextIndex(cat.spark, f"{shared_folder(cat.spark)}/text-index-{name}")
    if index.versions.latest() is None:
        index.build(search.search_rows(cat))
    return index


def stamp_of(spark: SparkSession, sf_dir: str) -> str:
    """Path, size and time of every table below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sf_dir + "|" + "|".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in found))
