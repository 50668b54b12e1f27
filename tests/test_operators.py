import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenshelf.functions import text as T
from lumenshelf.operators import features, ingest, review, search, vectors
from lumenshelf.operators.filters import BadRequest, Visibility, visible
from lumenshelf.queries import QUERIES
from lumenshelf.registry import search as registered
from lumenshelf.sources.fixtures import Catalog
from lumenshelf.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "tokens"),
    [
        ("AK47_LowPoly.fbx", ["ak47", "ak", "47", "lowpoly", "low", "poly", "fbx"]), ("", []), ("a b", []), ("fooBarBAZ9x", ["foobarbaz9x", "foo", "bar", "baz"]),
        ("Straße_Öl2", ["straße", "öl2", "öl"]), ("x--yy__yy", ["yy"]), ("ß", ["ß"]),
    ],
)
def test_name_tokens(spark, name, tokens):
    assert one(spark, T.name_tokens(F.lit(name))) == tokens


def test_folder_tokens_leave_the_name_out(spark):
    assert one(spark, T.folder_tokens(F.lit("Weapons_AK47/rifle.fbx"))) == ["weapons", "ak47", "ak", "47"]
    assert one(spark, T.folder_tokens(F.lit("rifle.fbx"))) == []


def test_query_groups():
    assert T.query_groups("!!") == []
    assert "ak47" in T.query_groups("gun")[0] and len(T.query_groups("gun metal")) == 2


def test_case_folds_ascii_only(spark):
    assert one(spark, T.nocase(F.lit("ÀBc"))) == "Àbc"


def rows_for_search(spark, docs):
    base = [(i, n, n.split("."), n.split("."), [], [], [], b.split()) for i, (n, b) in enumerate(docs)]
    return spark.createDataFrame(base, "id long, name string, filename array<string>, tokens array<string>, tags array<string>, note array<string>, folder array<string>, body array<string>")


def test_a_name_beats_any_number_of_mentions(spark):
    rows = rows_for_search(spark, [("hero.png", "x"), ("other.png", "hero " * 200), ("none.png", "y")])
    got = {r["id"]: r["tier"] for r in search.ranked(rows, [["hero"]]).collect()}
    assert got == {0: 0, 1: 1}


def test_bm25_by_hand(spark):
    docs = [("a.x", "red red blue"), ("b.x", "red"), ("c.x", "green green green green")]
    got = {r["id"]: r["rank"] for r in search.ranked(rows_for_search(spark, docs), [["red"]]).collect()}
    lengths = [2 + 2 + len(b.split()) for _, b in docs]
    mean = sum(lengths) / 3
    idf = max(math.log((3 - 2 + 0.5) / (2 + 0.5)), 1e-6)
    for i, tf in ((0, 2), (1, 1)):
        assert got[i] == pytest.approx(-idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[i] / mean)))


def vector_rows(spark, seed=0, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[np.arange(n) % 12] + 0.15 * rng.standard_normal((n, dim))
    return x, spark.createDataFrame([(i, f"s{i % 2}", [float(v) for v in r]) for i, r in enumerate(x)], "id long, space_id string, vec array<float>")


def test_cosine_of_odd_vectors(spark):
    c = lambda a, b: one(spark, vectors.cosine(vectors.literal(a), vectors.literal(b)))
    assert c([1, 0], [1, 0, 0]) == 0 and c([0, 0], [1, 0]) == 0 and c([1, 1], [2, 2]) == pytest.approx(1)


@pytest.mark.parametrize("block", [1024, 37])
def test_close_pairs_are_exact(spark, block):
    x, rows = vector_rows(spark)
    unit = x.astype(np.float32) / np.linalg.norm(x.astype(np.float32), axis=1, keepdims=True)
    sims = unit @ unit.T
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if i % 2 == j % 2 and sims[i, j] >= 0.9}
    got = {(r["a"], r["b"]) for r in vectors.close_pairs(rows, 0.9, block).collect()}
    assert {p for p in got ^ want if abs(sims[p] - 0.9) > 1e-5} == set()


@pytest.mark.parametrize("block", [1024, 37])
def test_near_links_lose_no_pair(spark, block):
    """Far-apart vectors at a low threshold, copies and vectors without a norm among them."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    x[300:340], x[340:350] = x[7], 0.0
    rows = spark.createDataFrame([(i, f"s{i % 2}", [float(v) for v in r]) for i, r in enumerate(x)], "id long, space_id string, vec array<float>")
    links = vectors.near_links(rows, 0.35, block)
    assert links.count() <= 400 * (1 + 400 // block)
    roots = lambda pairs: {r["id"]: r["root"] for r in vectors.components(pairs).collect()}
    assert roots(links) == roots(vectors.close_pairs(rows, 0.35))


def test_registered_near_duplicates_lose_no_pair(spark, sf_dir):
    rows = registered.spaces(Catalog(spark, sf_dir), 3)
    want = vectors.near_groups(rows, vectors.close_pairs(rows, registered.LEAST)).collect()
    assert want and sorted(QUERIES["near_dup_ann"](spark, sf_dir).collect()) == sorted(want)


def test_approximate_neighbours_recall(spark):
    x, rows = vector_rows(spark, n=600)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = vectors.nearest_by_blocks(rows, rows.where("id % 50 = 0").withColumnRenamed("id", "qid"), 10).collect()
    hits = total = 0
    for q in range(0, 600, 50):
        same = [i for i in range(600) if i % 2 == q % 2 and i != q]
        best = set(sorted(same, key=lambda i: -unit[q] @ unit[i])[:10])
        hits += len(best & {r["id"] for r in got if r["qid"] == q})
        total += 10
    assert hits / total >= 0.9


def test_registered_neighbours_are_exact(spark, sf_dir):
    """Every query of the embeddings table has its ten best, ties by id."""
    rows = registered.spaces(Catalog(spark, sf_dir)).orderBy("id").collect()
    ids, x = np.array([r["id"] for r in rows]), np.array([r["vec"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        order = [j for j in np.lexsort((ids, -np.round(x @ x[q], 6))) if j != q][:10]
        want |= {(int(ids[q]), int(ids[j]), rank) for rank, j in enumerate(order, 1)}
    assert {(r["qid"], r["id"], r["rank"]) for r in QUERIES["knn_ann"](spark, sf_dir).collect()} == want


def test_neighbours_over_many_blocks(spark):
    """Copies tie, and small blocks give what one block gives; a space with few rows gives all of them."""
    x, rows = vector_rows(spark, n=120)
    rows = rows.unionByName(rows.where("id < 60").withColumn("id", F.col("id") + 1000)).unionByName(rows.where("id < 3").withColumns({"id": F.col("id") + 5000, "space_id": F.lit("small")}))
    asked = rows.where("id % 10 = 0 OR id = 5001").withColumnRenamed("id", "qid")
    whole, cut = ({tuple(r) for r in vectors.nearest_by_blocks(rows, asked, 7, n).collect()} for n in (1024, 13))
    assert whole == cut and {r[1] for r in whole if r[0] == 5001} == {5000, 5002}


def test_components_of_chains_and_a_hidden_bridge(spark):
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(30), 100 + rnd.randrange(30)) for _ in range(25)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["root"] for r in vectors.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}


def test_unknown_space_and_dimension(spark):
    _, rows = vector_rows(spark, n=12)
    for space, vec in (("nowhere", [0.0] * 16), ("s0", [0.0])):
        with pytest.raises(BadRequest):
            vectors.checked_vector(rows, space, vec)
    assert vectors.nearest_to_asset(rows, 999, 5).collect() == []


def test_recount_after_each_transition(spark, sf_dir):
    """Kept counts equal the tables after every step."""
    cat = Catalog(spark, sf_dir)
    marked = ingest.mark_missing(cat.asset, cat.asset.where("id % 3 <> 0"), "src2", 1, 1)
    missing = {r["id"] for r in marked.where("flags & 1 <> 0").collect()}
    before = {r["id"] for r in cat.asset.where("flags & 1 <> 0").collect()}
    assert missing - before == {r["id"] for r in cat.asset.where("source_id = 'src2' AND id % 3 = 0 AND flags & 1 = 0").collect()}
    again = ingest.mark_missing(cat.asset, cat.asset.where("id % 3 <> 0"), "src2", 1, 2)
    assert {r["id"] for r in again.where("flags & 1 <> 0").collect()} == before


STEPS = {("suggested", "accept"): "confirmed", ("suggested", "reject"): "rejected", ("confirmed", "undo"): "suggested", ("rejected", "undo"): "suggested"}


def test_review_steps(spark):
    tags = spark.createDataFrame([(k, 1, s, "auto", 0.5) for k, s in enumerate(("suggested", "confirmed", "rejected"))] + [(9, 1, "suggested", "user", 0.5)], "asset_id long, tag_id long, state string, source string, confidence double")
    actions = spark.createDataFrame([(k, 1, a) for k in (0, 1, 2, 9) for a in ("accept", "reject", "undo")], "asset_id long, tag_id long, action string")
    states = {0: "suggested", 1: "confirmed", 2: "rejected"}
    for r in review.reviewed(tags, actions).collect():
        if r["asset_id"] == 9:
            assert r["outcome"] == "not_found"
        else:
            step = STEPS.get((states[r["asset_id"]], r["action"]))
            assert (r["outcome"], r["state"]) == (("ok", step) if step else ("bad_request", states[r["asset_id"]]))


def test_tag_names():
    assert review.tag_names([" A ", "a", "", "b"]) == ["a", "b"]
    with pytest.raises(BadRequest):
        review.tag_names(["x" * 65])
    with pytest.raises(BadRequest):
        review.tag_names([str(k) for k in range(51)])


def test_license_matrix(spark):
    values = [None, True, False]
    rows = [(k, i, c, m, r, a) for k, (i, c, m, r, a) in enumerate((i, c, m, r, a) for i in (None, "x") for c in values for m in values for r in values for a in values)]
    table = spark.createDataFrame(rows, "id long, license_id string, commercial boolean, modify boolean, redistribute boolean, attribution boolean")
    for r in table.select("*", review.license_status().alias("s")).collect():
        rights = (r["commercial"], r["modify"], r["redistribute"], r["attribution"])
        want = "unknown" if r["license_id"] is None or None in rights else "restricted" if False in rights[:3] else "attribution" if rights[3] else "permissive"
        assert r["s"] == want


def test_text_descriptors():
    a, b, c = (np.array(features.text_descriptor(t)) for t in ("red stone wall in the town", "stone wall of the red town", "completely unrelated sentence about music"))
    assert np.linalg.norm(a) == pytest.approx(1, abs=1e-6) and a @ b > 0.6 > 0.3 > a @ c
    assert features.text_descriptor("a b !!") is None and features.text_descriptor(None) is None
    assert features.fnv1a("a") == 0xAF63DC4C8601EC8C


def test_image_and_sound():
    tone = np.sin(2 * np.pi * 440 * np.arange(22050) / 22050)
    assert max(features.peaks(tone)) == 1 and features.peaks(np.zeros(0)) == []


def test_stream_equals_batch(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = events.change_feed(spark, path)
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(events.drained_state(events.kept_counts(stream)).collect()) == sorted(events.kept_counts(batch).collect())
    windows = events.drained(events.windowed_counts(events.change_feed(spark, path)))
    final = {tuple(r) for r in events.windowed_counts(batch).collect()}
    assert {tuple(r) for r in windows.collect()} <= final


def test_job_cancellation_wins(spark):
    rows = [("a", 1, "running", 1, 10), ("a", 2, "cancelled", 2, 10), ("a", 3, "done", 10, 10), ("b", 1, "running", 5, 0)]
    got = {r["job"]: (r["state"], r["progress"]) for r in events.job_state(spark.createDataFrame(rows, "job string, version int, state string, done long, total long")).collect()}
    assert got == {"a": ("cancelled", 1.0), "b": ("running", None)}


def test_job_visibility(spark):
    rows = [(["s1"], [1]), (["s1", "s9"], []), ([], []), ([], [1])]
    table = spark.createDataFrame(rows, "s array<string>, c array<long>")
    assert [r["v"] for r in table.select(events.job_visible(F.col("s"), F.col("c"), ["s1"], [1]).alias("v")).collect()] == [True, False, False, True]


def test_hidden_assets_do_not_bridge(spark, sf_dir):
    cat = Catalog(spark, sf_dir)
    rows = spark.createDataFrame([(1, "s", [1.0, 0.0]), (2, "s", [0.95, 0.31]), (3, "s", [0.81, 0.59])], "id long, space_id string, vec array<float>")
    whole = {r["id"]: r["root"] for r in vectors.components(vectors.close_pairs(rows, 0.92)).collect()}
    assert whole == {1: 1, 2: 1, 3: 1}
    assert vectors.close_pairs(rows.where("id <> 2"), 0.92).collect() == []
    assert visible(cat, cat.asset, Visibility.only(["src1"])).where("source_id <> 'src1'").count() == 0


def test_jobs_under_a_ceiling(spark):
    jobs = [
        (1, '["s1"]', None),
        (2, '["s1","s2"]', None),
        (3, None, '["7"]'),
        (4, '["s1"]', '["8"]'),
        (5, None, None),
        (6, "[]", ""),
        (7, '["s1"', None),
        (8, '{"a": 1}', None),
        (9, "[null]", None),
        (10, '["s1", "s1"]', '["7"]'),
    ]
    rows = spark.createDataFrame(jobs, "id long, sources string, collections string")
    seen = lambda ceiling: sorted(r["id"] for r in review.jobs_visible(rows, ceiling).collect())
    assert seen(Visibility()) == list(range(1, 11))
    assert seen(Visibility.only(["s1"], [7])) == [1, 3, 10]
    assert seen(Visibility.only(["s1", "s2"])) == [1, 2]
    assert seen(Visibility.only()) == []


def test_spaces_are_told_by_dimension(spark):
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, "a", [1.0]), (3, "a", [1.0, 2.0]), (4, None, [1.0]), (5, "b", None)], "id long, space_id string, vec array<double>")
    assert {tuple(r) for r in vectors.spaces_of(rows).collect()} == {("a", 1, 2), ("a", 2, 1), (None, 1, 1)}
