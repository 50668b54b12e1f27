"""Kept counters: built once, then moved by the before and after images of a change feed, each batch exactly once."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenshelf.functions.storage import Conflict, Versions, shared_folder
from lumenshelf.operators import aggregates
from lumenshelf.operators.filters import Visibility
from lumenshelf.operators.textindex import stamp_of
from lumenshelf.sources.fixtures import Catalog

#: The finest counters; coarser ones are their sums.
KEYS = ["source_id", "media_type"]
IMAGE = "struct<source_id:string,media_type:string,flags:int,analysed_at:bigint>"


class Counters:
    """Counters by source and media type, and of tags by source, under one manifest.

    A version names the parts and, for each feed, the last batch that is in them. A batch comes again
    when a stream stopped between publishing its version and noting the batch as done; its number tells that, and
    it changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def build(self, cat: Catalog) -> dict:
        """Count everything, as after an import."""
        parts = {}
        for kind, table in (("assets", aggregates.maintained(cat, "source_media_stat")), ("tags", aggregates.maintained(cat, "source_tag_stat"))):
            parts[kind] = self.versions.part(kind)
            table.coalesce(1).write.parquet(self.versions.at(parts[kind]))
        latest = self.versions.latest()
        return self.versions.publish({"parts": parts, "batches": {}}, latest["number"] if latest else 0)

    def table(self, kind: str = "assets") -> DataFrame:
        manifest = self.versions.latest()
        if manifest is None:
            raise ValueError("the counters are not built yet")
        return self.spark.read.parquet(self.versions.at(manifest["parts"][kind]))

    def apply(self, changes: DataFrame, feed: str, batch: int) -> bool:
        """Take in a batch of changes (before and after, each IMAGE or null); False if it was in already.

        A writer that was overtaken looks again: the other may have brought this very batch.
        """
        for _ in range(3):
            manifest = self.versions.latest()
            if batch <= manifest["batches"].get(feed, -1):
                return False
            image = lambda side: changes.where(F.col(side).isNotNull()).select(f"{side}.*")
            deltas = aggregates.counter_deltas(image("before"), image("after"), KEYS)
            part = self.versions.part("assets")
            kept = self.spark.read.parquet(self.versions.at(manifest["parts"]["assets"]))
            aggregates.with_deltas(kept, deltas, KEYS).coalesce(1).write.parquet(self.versions.at(part))
            told = manifest | {"parts": manifest["parts"] | {"assets": part}, "batches": manifest["batches"] | {feed: batch}}
            try:
                self.versions.publish(told, manifest["number"])
            except Conflict:
                continue
            self.versions.clean(keep=3)
            return True
        raise Conflict("other writers were faster three times")

    def follow(self, changes: DataFrame, log: str):
        """A stream's changes, batch by batch, until all that is there has been taken in; ``log`` names the feed."""
        return changes.writeStream.foreachBatch(lambda rows, number: self.apply(rows, log, number) and None).option("checkpointLocation", log).trigger(availableNow=True).start()

    def by(self, *keys: str) -> DataFrame:
        """The counters summed by source, by media type, or over all."""
        return self.table().groupBy(*keys).agg(*[F.sum(c).alias(c) for c in aggregates.COUNTERS])

    def total(self, cat: Catalog, ceiling: Visibility) -> DataFrame:
        """The visible total, from counters where whole sources make it up. Collections overlap them, so a ceiling
        with collections is counted on the assets."""
        if ceiling.collections:
            return aggregates.total_from_maintained(cat, ceiling)
        kept = self.table()
        if not ceiling.full:
            kept = kept.where(F.col("source_id").isin(sorted(ceiling.sources)) if ceiling.sources else F.lit(False))
        return kept.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "unanalysed")])


def kept_counters(cat: Catalog) -> Counters:
    """The counters of a catalogue: built at first use, and again when a table has changed."""
    name = sha256(stamp_of(cat.spark, cat.sf_dir).encode()).hexdigest()[:24]
    counters = Counters(cat.spark, f"{shared_folder(cat.spark)}/counters-{name}")
    if counters.versions.latest() is None:
        counters.build(cat)
    return counters


def images(rows: DataFrame, side: str) -> DataFrame:
    """One image of asset rows for a feed of changes; the other side is null."""
    image = F.struct("source_id", "media_type", F.col("flags").cast("int").alias("flags"), F.col("analysed_at").cast("long").alias("analysed_at"))
    none = F.lit(None).cast(IMAGE)
    return rows.select(*[(image if s == side else none).alias(s) for s in ("before", "after")])
