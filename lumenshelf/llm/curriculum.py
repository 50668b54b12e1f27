"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenshelf.llm.common import WORD_RUN, cut, id_key, join_groups, text_or_empty

#: A weight schedule: (training time from 0 to 1, weight) knots, linear in between. Sources in code
#: point order take these in turn; their integrals, the overall weights, are 1, 2 and 3.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 2.0), (1.0, 4.0)),
)
#: No source is repeated beyond this many times its size.
MAX_EPOCHS = 3
#: Hex digits of the order hash that cut each source's order into pieces summed on their own.
BUCKET_DIGITS = 3
#: Rounds that fill the gap which the first document too long for it leaves.
FILL_ROUNDS = 2


def words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD_RUN)).cast("long")


def integrals(knots: Sequence[tuple[float, float]]) -> list[float]:
    """The integral of a schedule from 0 up to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def by_schedule(schedules: Sequence, pick: Column, value) -> Column:
    """A column that differs by the number of the schedule."""
    out = value(schedules[-1])
    for k in range(len(schedules) - 2, -1, -1):
        out = F.when(pick == k, value(schedules[k])).otherwise(out)
    return out


def inverse_demand(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """The time by which ``share`` (0 to 1) of a source's tokens are demanded: its cumulative
    schedule, a quadratic on each piece, inverted."""
    sums = integrals(knots)
    want = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(sums[-1])
    out = F.lit(float(knots[-1][0]))
    for k in range(len(knots) - 2, -1, -1):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        slope, rest = (w1 - w0) / (t1 - t0), want - F.lit(sums[k])
        # Of the root's two forms this one holds for slope zero too.
        step = 2 * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * F.lit(slope) * rest, F.lit(0.0))))
        out = F.when(want <= F.lit(sums[k + 1]), F.lit(t0) + F.when(rest <= 0, F.lit(0.0)).otherwise(step)).otherwise(out)
    return out


def source_targets(sizes: DataFrame, schedules: Sequence = SCHEDULES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Each source's target: its share of all words by weight, capped, the excess reshared.

    sizes has one row per source: source, source_size. In order of cap over weight, a source is
    capped if its cap lies below its share of what the sources capped before it leave.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_pick", (F.row_number().over(order) - 1) % len(schedules))
    ranked = ranked.withColumn("_w", by_schedule(schedules, F.col("_pick"), lambda k: F.lit(integrals(k)[-1])))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    total, weight = F.sum("source_size").over(all_rows).cast("double"), F.sum("_w").over(all_rows)
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ranked = ranked.withColumns({"_total": total, "_weight": weight, "_level": left / (weight - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))})
    ranked = ranked.withColumn("_capped", F.col("_cap") < F.col("_w") * F.col("_level"))
    capped = lambda c: F.coalesce(F.sum(F.when(F.col("_capped"), F.col(c))).over(all_rows), F.lit(0.0))
    ranked = ranked.withColumn("_final", (F.col("_total") - capped("_cap")) / (F.col("_weight") - capped("_w")))
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_w") * F.col("_final"), F.col("_cap")))
    return ranked.select("source", "source_size", "_pick", target.alias("target"))


def running_sum(places: DataFrame, value: Column) -> DataFrame:
    """places with _before: the sum of ``value`` over the rows of the same source ahead in the order.

    The sum is taken per (source, first digits of the order hash), on top of the sums of the pieces
    before, so a source with a third of all rows is spread over thousands of groups.
    """
    valued = places.withColumn("_value", value)
    ahead = Window.partitionBy("_sk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    pieces = valued.groupBy("_sk", "_bucket").agg(F.sum("_value").alias("_piece"))
    starts = pieces.select("_sk", "_bucket", F.coalesce(F.sum("_piece").over(ahead), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_sk", "_bucket").orderBy("_order", "_idk", "size").rowsBetween(Window.unboundedPreceding, -1)
    valued = valued.withColumn("_in", F.coalesce(F.sum("_value").over(inner), F.lit(0))).join(starts, ["_sk", "_bucket"])
    return valued.withColumn("_before", F.col("_start") + F.col("_in")).drop("_value", "_in", "_start")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", schedules: Sequence = SCHEDULES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """How often each document is taken, and where its copies stand.

    One row per distinct (source, id, size): _sk, _idk, size, source_size, target, copies, taken,
    before (words of its source that precede it in a pass) and _pick.
    Every source is passed over whole while its target allows. The last, partial pass takes documents
    in the order of md5(id) up to the first that would overrun the target; further rounds then fill
    the gap that it leaves with documents no longer than the gap, each round in the same order, so the
    gap at least halves with each. The order is a hash of the id alone: reruns agree.
    Rows that repeat source, id and size share a place and are all taken equally often. Null texts
    have no words; null sources are one source; null ids are one id; an empty table has an empty plan.
    """
    rows = docs.select(F.col(source_col).alias("source"), id_key(id_col).alias("_idk"), words(text_col).alias("size"))
    rows = rows.withColumn("_sk", source_key("source"))
    places = cut(rows.groupBy("_sk", "source", "_idk", "size").agg((F.col("size") * F.count(F.lit(1))).alias("_all")))
    sources = cut(places.groupBy("source").agg(F.sum("_all").alias("source_size"), F.count(F.lit(1)).alias("_places")))
    targets = source_targets(sources.drop("_places"), schedules, max_epochs).join(sources.select(F.col("source").alias("_s"), "_places"), F.col("source").eqNullSafe(F.col("_s")))
    targets = targets.select(source_key("source").alias("_sk"), "source_size", "target", "_pick", "_places")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = cut(targets.withColumn("_passes", F.least(passes.cast("int"), F.lit(max_epochs))))
    places = places.withColumn("_order", F.md5("_idk")).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    total = places.count()
    with_source = lambda rows, values: join_groups(rows, values, "_sk", "_places", total, F.col("_idk")).drop("_places")
    plan = with_source(running_sum(places.drop("source"), F.col("_all")).withColumnRenamed("_before", "before"), targets)
    rest = F.col("target") - F.col("_passes") * F.col("source_size")
    plan = cut(plan.withColumn("_extra", (F.col("_all") > 0) & (F.col("before") + F.col("_all") <= rest)))
    for _ in range(FILL_ROUNDS):
        used = plan.groupBy("_sk").agg(F.sum(F.when(F.col("_extra"), F.col("_all")).otherwise(F.lit(0))).alias("_used"))
        gaps = cut(used.join(targets, "_sk").select("_sk", (rest - F.col("_used")).alias("_gap"), "_places"))
        open_ = with_source(plan, gaps)
        fits = ~F.col("_extra") & (F.col("_all") > 0) & (F.col("_all") <= F.col("_gap"))
        filled = running_sum(open_, F.when(fits, F.col("_all")).otherwise(F.lit(0)))
        plan = cut(filled.withColumn("_extra", F.col("_extra") | (fits & (F.col("_before") + F.col("_all") <= F.col("_gap")))).drop("_before", "_gap"))
    plan = plan.withColumn("copies", F.col("_passes") + F.col("_extra").cast("int"))
    return plan.select("_sk", "_idk", "size", "source_size", "target", "before", "_pick", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def source_key(source: str) -> Column:
    """A join key for sources that never is null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def position(pass_no: Column, schedules: Sequence = SCHEDULES) -> Column:
    """Training position, 0 to 1, of a document's copy in the given pass over its source."""
    middle = pass_no * F.col("source_size") + F.col("before") + F.col("size") / 2
    share = F.when(F.col("target") > 0, middle / F.col("target")).otherwise(F.lit(0.0))
    return by_schedule(schedules, F.col("_pick"), lambda k: inverse_demand(k, share))


def with_plan(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows with what the plan says of them."""
    keyed = docs.withColumns({"_idk": id_key(id_col), "_sk": source_key(source_col), "size": words(text_col)})
    return keyed.join(plan, ["_sk", "_idk", "size"])


def training_sequence(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", schedules: Sequence = SCHEDULES, max_epochs: int = MAX_EPOCHS, position_col: str | None = "position") -> DataFrame:
    """The mixed corpus: every taken copy as a row with its position, range-sorted by position.

    Copies of one document stand one pass apart. Documents that the mix does not take, and those
    without words, have no rows. The input's own columns come back, with the position last under the name
    ``position_col``, which must be free, or without it if that is None.
    """
    plan = mix_plan(docs, id_col, source_col, text_col, schedules, max_epochs)
    base = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    named = dict(zip(docs.columns, base.columns))
    rows = with_plan(base, plan, named[id_col], named[source_col], named[text_col]).where("copies > 0 AND size > 0")
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.withColumn("_position", position(F.col("_pass"), schedules)).orderBy("_position", named[id_col])
    last = [F.col("_position").alias(position_col)] if position_col else []
    return rows.select(*[F.col(b).alias(a) for a, b in named.items()], *last)
