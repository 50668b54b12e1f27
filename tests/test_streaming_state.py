import shutil
import time

from pyspark.sql import functions as F

from lumenshelf.operators import aggregates
from lumenshelf.sources.fixtures import Catalog
from lumenshelf.streaming import counters, events, state


def feed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))


def test_a_stopped_and_replayed_stream_counts_once(spark, sf_dir, tmp_path):
    cat = Catalog(spark, sf_dir)
    kept = counters.Counters(spark, str(tmp_path / "kept"))
    kept.build(cat)
    gone, moved = cat.asset.where("id % 9 = 0"), cat.asset.where("id % 9 = 1")
    after = moved.withColumns({"media_type": F.lit("video"), "flags": F.lit(1), "analysed_at": F.lit(None).cast("long")})
    source = tmp_path / "feed"
    counters.images(gone, "before").coalesce(1).write.parquet(str(source / "a"))
    stream = lambda: spark.readStream.schema(f"before {counters.IMAGE}, after {counters.IMAGE}").option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    log = str(tmp_path / "log")
    kept.follow(stream(), log).awaitTermination()
    number = kept.versions.latest()["number"]
    shutil.copytree(f"{log}/commits", tmp_path / "commits")
    counters.images(moved, "before").unionByName(counters.images(after, "after")).coalesce(1).write.parquet(str(source / "b"))
    kept.follow(stream(), log).awaitTermination()
    # The stream dies before it notes the second batch as done, and takes it up again.
    shutil.rmtree(f"{log}/commits")
    shutil.copytree(tmp_path / "commits", f"{log}/commits")
    kept.follow(stream(), log).awaitTermination()
    assert kept.versions.latest()["number"] == number + 1
    now = cat.asset.where("id % 9 > 1").unionByName(after.select(*cat.asset.columns))
    assert aggregates.drift(kept.table(), now, counters.KEYS).isEmpty() and kept.by().first()["n"] == now.count()
    assert not kept.apply(counters.images(gone, "before"), log, 0)
    plan = kept.total(cat, counters.Visibility.only(["src1"]))._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "part.parquet" not in plan


def batches(spark, result, name):
    """Run a stream over all that is there, keep what each batch puts out."""
    out = []
    query = result.writeStream.outputMode("append" if name == "watch" else "update").foreachBatch(lambda rows, n: out.extend(tuple(r) for r in rows.collect()))
    return out, query


def test_quiet_sources(spark, tmp_path):
    schema = "source_id string, path string"
    put(spark, tmp_path / "in", [("a", "x"), ("a", "y"), ("b", None)], schema)
    put(spark, tmp_path / "in", [("a", "x"), ("c", "only")] + [("d", f"p{k}") for k in range(600)], schema)
    out, query = batches(spark, state.watched(feed(spark, tmp_path / "in", schema)), "watch")
    running = query.option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="200 milliseconds").start()
    until = time.time() + 60
    while len({r[0] for r in out}) < 4 and time.time() < until:
        time.sleep(0.2)
    running.stop()
    told = {}
    for source, changes, paths, rescan in out:
        old = told.get(source, (0, set(), False))
        told[source] = (old[0] + changes, old[1] | set(paths), old[2] or rescan)
    assert told == {"a": (3, {"x", "y"}, False), "b": (1, set(), True), "c": (1, {"only"}, False), "d": (600, set(), True)}


def test_polls_slow_down(spark, tmp_path):
    schema = "source_id string, poll long, changed boolean"
    for rows in ([("a", 1, False), ("b", 1, True)], [("a", 2, False), ("a", 3, False)], [("a", 2, False), ("b", 2, False)], [("a", 4, True)] + [("c", k, False) for k in range(1, 12)]):
        put(spark, tmp_path / "in", rows, schema)
        time.sleep(0.05)
    out, query = batches(spark, state.paced(feed(spark, tmp_path / "in", schema)), "poll")
    query.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for source, poll, seconds in out:
        last[source] = max(last.get(source, (0, 0)), (poll, seconds))
    assert last == {"a": (4, 15), "b": (2, 30), "c": (11, 900)}
    assert ("a", 3, 120) in out


def test_jobs_over_batches_equal_one_batch(spark, tmp_path):
    schema = "job long, version long, state string, done long, total long"
    rows = [(1, 1, "running", 1, 4), (1, 3, "done", 4, 4), (1, 2, "running", 2, 4), (2, 1, "running", 1, 2), (2, 2, "cancelled", 1, 2), (2, 3, "done", 2, 2), (3, 1, "running", 0, 0), (1, 3, "done", 4, 4)]
    for k in range(0, len(rows), 2):
        put(spark, tmp_path / "in", rows[k : k + 2], schema)
        time.sleep(0.05)
    out, query = batches(spark, state.jobs_followed(feed(spark, tmp_path / "in", schema)), "job")
    query.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for job, _, name, done, progress in out:
        last[job] = (name, done, None if progress != progress else progress)
    whole = events.job_state(spark.createDataFrame(rows, schema)).collect()
    assert last == {r["job"]: (r["state"], r["done"], r["progress"]) for r in whole}
