import pytest
from pyspark.sql import functions as F

from lumenshelf.operators import search, textindex
from lumenshelf.sources.fixtures import Catalog

NAMES = ["Straße_Öl.png", "ÉCOLE-élève.wav", "日本語の名前.glb", "İstanbul.mp4", "a", "", "ab", "😀😀😀.png", "CamelCase99x.txt", "ﬁle.png", "éecole.txt", "école.txt"]


def named(spark, names):
    empty = "array('x')"
    return spark.createDataFrame(list(enumerate(names)), "id long, name string").selectExpr("id", "name", *[f"{empty} AS {c}" for c in search.WEIGHTS])


def test_grams_find_what_contains_finds(spark, tmp_path):
    table = named(spark, NAMES * 3)
    found = textindex.TextIndex(spark, str(tmp_path)).build(table)
    for text in ("öl.", "ÉCO", "eco", "本語の", "İst", "ist", "😀😀😀", "case99", "ﬁle", "fil", "png", "ab", "zzz", "éc", "Straße_Öl.png"):
        want = {r["id"] for r in search.substring_hits(table, text).collect()}
        assert {r["id"] for r in found.substring_hits(text).collect()} == want, text


def ranks(frame):
    return sorted((r["id"], r["tier"], round(r["rank"], 6)) for r in frame.collect())


def test_edits_equal_a_fresh_scan(spark, sf_dir, tmp_path):
    all_rows = search.search_rows(Catalog(spark, sf_dir)).where("id % 3 = 0")
    index = textindex.TextIndex(spark, str(tmp_path))
    first = index.build(all_rows.where("id % 2 = 0"))
    texts = ("ring promo", "idge")
    before = [ranks(first.hits(t)) for t in texts]
    now = {"even": all_rows.where("id % 2 = 0")}
    steps = [
        (all_rows.where("id % 2 = 1 AND id % 7 = 0"), "id % 4 = 0"),
        (all_rows.where("id % 8 = 0").selectExpr("id", "concat('idge', name) AS name", "filename", "tokens", "array('promo') AS tags", "note", "folder", "array('ring') AS body"), "false"),
        (all_rows.where("id % 2 = 1 AND id % 7 = 1"), "id % 14 = 7"),
        (all_rows.where("false"), "id % 5 = 0"),
    ]
    current = now["even"]
    for k, (upserts, gone) in enumerate(steps):
        deleted = current.where(gone).select("id")
        found = index.apply(upserts, deleted)
        path = str(tmp_path / f"expected-{k}")
        current.join(deleted, "id", "left_anti").join(upserts.select("id"), "id", "left_anti").unionByName(upserts.select(*current.columns)).write.parquet(path)
        current = spark.read.parquet(path)
        n, length = current.agg({"id": "count"}).first()[0], found.table("rows").agg({"length": "sum"}).first()[0]
        assert (found.manifest["n"], found.manifest["length"]) == (n, length)
        for t in texts:
            groups = search.T.query_groups(t)
            words = search.ranked(current, groups)
            rest = search.substring_hits(current, t).select("id").join(words.select("id"), "id", "left_anti")
            want = ranks(words.select("id", "tier", "rank")) + [(r["id"], 2, search.SUBSTRING_RANK) for r in rest.collect()]
            assert ranks(found.hits(t)) == sorted(want), t
    assert len(found.manifest["segments"]) < 5  # some were merged
    assert [ranks(first.hits(t)) for t in texts] == before  # a reader of the first version sees it still


def test_search_reads_no_document(spark, sf_dir):
    found = textindex.kept_index(Catalog(spark, sf_dir)).snapshot().search("src1 the", 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "StringStartsWith(term" in plan
    assert found.count() == 20
    keep = spark.range(0, 60)
    assert {r["id"] for r in textindex.kept_index(Catalog(spark, sf_dir)).snapshot().search("the", 20, keep).collect()} <= set(range(60))


def test_postings_are_counted_within_rows(spark):
    """A grouping by token and row keeps each of them in a task's memory, and a term's rows in one task."""
    from collections import Counter

    rows = [(k, f"n{k}", ["the", "a"], ["the"], [], ["the", "b"] * (k % 3), [], ["the", f"w{k % 7}", "the"]) for k in range(3000)]
    rows += [(3000, "none", [], [], [], [], [], []), (3001, "null", None, ["x"], [], [], [], [])]
    frame = spark.createDataFrame(rows, "id long, name string, " + ", ".join(f"{c} array<string>" for c in search.WEIGHTS))
    plan = search.counted(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    terms, lengths = search.postings(frame)
    want, told = Counter(), set()
    for r in rows[:-1]:
        for (column, weight), tokens in zip(search.WEIGHTS.items(), r[2:]):
            for t in tokens:
                want[r[0], t] += weight
                told |= {(r[0], t)} if column in search.AUTHORED else set()
    assert {(r["id"], r["term"]): (r["weight"], r["authored"]) for r in terms.collect()} == {k: (w, k in told) for k, w in want.items()}
    assert terms.count() == len(want) and lengths.count() == len(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = search.in_order(terms.where("term = 'the'"), "term", "id").rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 2000  # of 3,000


def test_a_task_sorts_no_more_rows_of_a_longer_index(spark, monkeypatch):
    monkeypatch.setattr(search, "RANGE_ROWS", 500)
    for n in (3_000, 24_000):
        rows = spark.range(n).selectExpr("'the' AS term", "id")
        parts = search.in_order(rows, "term", "id").rdd.glom().collect()
        assert max(map(len, parts)) < 1_000
        assert [r["id"] for part in parts for r in part] == list(range(n))


def test_a_task_joins_no_more_of_longer_texts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(search, "JOIN_BYTES", 1 << 16)
    cat = Catalog(spark, sf_dir)
    texts = cat.base("documents").agg(F.sum(F.octet_length("text"))).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = search.search_rows(cat).groupBy(F.spark_partition_id()).agg(F.sum(F.size("body")).alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["rows"] for r in rows) == cat.asset.count()
    assert len(rows) > texts / (1 << 16) / 2 and max(r["n"] for r in rows) < sum(r["n"] for r in rows) / 4


def test_a_task_deals_no_more_postings_of_a_longer_table(spark, tmp_path, monkeypatch):
    """With over 200 ranges Spark keeps all that a task deals to them, so what a task reads must be bounded too."""
    monkeypatch.setattr(search, "SCAN_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(search, "ROW_GROUP", 1 << 15, raising=False)
    before, tracker, most = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.sparkContext.statusTracker(), []
    for n in (2_000, 16_000):
        words = lambda k: f"transform(sequence(1, {k}), j -> concat('w', xxhash64(id, j)))"
        rows = spark.range(n).selectExpr("id", "concat('n', id) AS name", *[f"{words(2 if c != 'body' else 8)} AS {c}" for c in search.WEIGHTS])
        spark.sparkContext.setJobGroup(f"dealt-{n}", "an index is built")
        found = textindex.TextIndex(spark, str(tmp_path / str(n))).build(rows)
        stages = {s for j in tracker.getJobIdsForGroup(f"dealt-{n}") for s in tracker.getJobInfo(j).stageIds}
        most.append(max(i.numTasks for i in map(tracker.getStageInfo, stages) if i))
        assert found.table("terms").count() == 8 * n and found.table("rows").count() == n
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert most[1] > 4 * most[0] and most[1] > 16
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
