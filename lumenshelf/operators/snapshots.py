"""Snapshots of near-duplicate groups with a time to live, against which decisions are checked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenshelf.functions.storage import Versions

#: Fixed value: how long a snapshot may be decided on.
TTL_MS = 900_000


class ReviewSnapshots:
    """What reviewers were shown: the members of each near group, when, and from which generation of each
    space's vectors. A snapshot is a version; the manifest names those that are not yet too old."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def take(self, members: DataFrame, generations: dict[str, int], now: int) -> dict:
        """Keep a page of groups (review_id, space_id, id) as shown at ``now``. Older snapshots that time has run out for are dropped."""
        latest = self.versions.latest() or {"number": 0, "shown": []}
        part = self.versions.part("members")
        members.select("review_id", "space_id", F.col("id").cast("long").alias("id")).repartition("review_id").write.parquet(self.versions.at(part))
        shown = [s for s in latest["shown"] if s["at"] >= now - TTL_MS]
        told = self.versions.publish({"shown": [*shown, {"members": part, "at": now, "generations": generations}]}, latest["number"])
        self.versions.clean(keep=1)
        return told

    def members(self, generations: dict[str, int], now: int) -> DataFrame:
        """Members (review_id, id) of the groups that may still be decided on: shown within TTL_MS, and
        of spaces whose vectors have not changed since."""
        latest = self.versions.latest() or {"shown": []}
        parts = []
        for s in latest["shown"]:
            same = [space for space, g in s["generations"].items() if generations.get(space) == g]
            if s["at"] >= now - TTL_MS and same:
                parts.append(self.spark.read.parquet(self.versions.at(s["members"])).where(F.col("space_id").isin(same)).select("review_id", "id"))
        return reduce(DataFrame.unionByName, parts).distinct() if parts else self.spark.createDataFrame([], "review_id string, id long")

    def decided(self, decisions: DataFrame, assets: DataFrame, generations: dict[str, int], now: int) -> DataFrame:
        """Outcomes of decisions (review_id, keep, removals): review_id, outcome and, where accepted, the assets to remove.

        invalid: no id of a near group. stale: shown too long ago, never, or the vectors have changed. gone: fewer than two members
        are still assets. foreign: keep or a removal is no member (a member that is no asset any more is none). Whatever is
        not accepted removes nothing.
        """
        live = self.members(generations, now).join(assets.select("id"), "id", "left_semi")
        fresh = self.members(generations, now).select("review_id").distinct().withColumn("_fresh", F.lit(True))
        sizes = live.groupBy("review_id").agg(F.count(F.lit(1)).alias("_n"))
        named = decisions.select("review_id", F.explode(F.array_union(F.coalesce("removals", F.array().cast("array<long>")), F.when(F.col("keep").isNotNull(), F.array("keep")).otherwise(F.array().cast("array<long>")))).alias("id"))
        foreign = named.join(live, ["review_id", "id"], "left_anti").select("review_id").distinct().withColumn("_foreign", F.lit(True))
        rows = decisions.join(fresh, "review_id", "left").join(sizes, "review_id", "left").join(foreign, "review_id", "left")
        valid = F.col("review_id").rlike("^near:[0-9a-f]{64}$")
        outcome = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.col("_fresh").isNull(), "stale").when(F.coalesce("_n", F.lit(0)) < 2, "gone").when(F.col("_foreign"), "foreign").otherwise("accepted")
        return rows.withColumn("outcome", outcome).select("review_id", "outcome", F.when(F.col("outcome") == "accepted", F.coalesce("removals", F.array().cast("array<long>"))).otherwise(F.array().cast("array<long>")).alias("removed"))
