import numpy as np
import pytest

from lumenshelf.functions.storage import Conflict, Versions, settled
from lumenshelf.operators import ann, vectors

SCHEMA = "id long, space_id string, vec array<double>"


def clustered(n, centres=12, dim=16, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(k, "s", (middle[k % centres] + spread * rng.normal(size=dim)).tolist()) for k in range(n)]


def brute(rows, queries, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = set()
    for q, s, v in queries:
        near = sorted((-round(float(unit(v) @ unit(w)), 6), i) for i, t, w in rows if t == s and i != q and len(w) == len(v))[:k]
        out |= {(q, i) for _, i in near}
    return out


def asked(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("id", "qid")


def pairs(frame):
    return {(r["qid"], r["id"]) for r in frame.collect()}


def test_search_in_cells(spark, tmp_path):
    rows = clustered(600) + [(1000, "s", [0.0] * 16), (1001, "s", [0.0] * 16), (2000, "t", [1.0, 0.0]), (2001, "t", [0.9, 0.1]), (2002, "t", [0.0, 0.0])]
    found = ann.VectorIndex(spark, str(tmp_path)).build(spark.createDataFrame(rows, SCHEMA))
    queries = [r for r in rows if r[0] % 50 == 0] + [(2001, "t", [0.9, 0.1])]
    want = brute(rows, queries, 5)
    assert pairs(found.search(asked(spark, queries), 5, 2, exact=True)) == want
    few = pairs(found.search(asked(spark, queries), 5, 2))
    assert len(few & want) >= 0.9 * len(want)
    assert found.rows().where("cell < 0").isEmpty() and found.rows().count() == len(rows)
    one = found.nearest(rows[7][2], 6, "s", 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert {r["id"] for r in one.collect()} - {7} == {i for _, i in brute(rows, [rows[7]], 5)}
    assert found.nearest([1.0], 3, "none").collect() == []


def test_tuning_reaches_the_recall(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, "s", rng.normal(size=8).tolist()) for k in range(500)]  # no structure: many cells are needed
    found = ann.VectorIndex(spark, str(tmp_path)).build(spark.createDataFrame(rows, SCHEMA))
    queries = rows[::10]
    want = brute(rows, queries, 10)
    assert len(pairs(found.search(asked(spark, queries), 10, found.tuned(10))) & want) >= 0.9 * len(want)


def test_generations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "COMPACT_AT", 40)
    rng, index = np.random.default_rng(2), ann.VectorIndex(spark, str(tmp_path))
    table = {(k, "s"): rng.normal(size=4).round(3).tolist() for k in range(60)}
    frame = lambda t: spark.createDataFrame([(i, s, v) for (i, s), v in t.items()], SCHEMA)
    seen = lambda snap: {(r["id"], r["space_id"]): list(r["vec"]) for r in snap.rows().collect()}
    first = index.build(frame(table))
    old, bases = dict(table), {first.manifest["base"]}
    for step in range(7):
        changes = []
        for seq in range(12):
            key = (int(rng.integers(0, 90)), "s" if rng.random() < 0.9 or step < 5 else "new")
            if rng.random() < 0.4:
                changes.append((*key, [], "delete", seq))
                table.pop(key, None)
            else:
                vec = rng.normal(size=4).round(3).tolist()
                changes.append((*key, vec, "upsert", seq))
                table[key] = vec
        snap = index.apply(spark.createDataFrame(changes, SCHEMA + ", op string, seq int"))
        bases.add(snap.manifest["base"])
        assert seen(snap) == table
        queries = [(i, s, v) for (i, s), v in list(table.items())[:8]]
        assert pairs(snap.search(asked(spark, queries), 3, 2, exact=True)) == brute([(i, s, v) for (i, s), v in table.items()], queries, 3)
    assert len(bases) > 2  # some were written anew
    assert seen(first) == old  # a reader that began before sees its own generation
    index.versions.clean(1)
    assert seen(index.snapshot()) == table and len(index.versions.numbers()) == 1


def test_two_writers(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    assert versions.latest() is None
    versions.publish({"a": 1}, 0)
    with pytest.raises(Conflict):
        versions.publish({"a": 2}, 0)
    assert versions.publish({"a": 3}, 1) == versions.latest() == {"a": 3, "number": 2}


@pytest.mark.parametrize("least", [0.92, 0.3])
def test_links_through_cells(spark, least):
    rows = clustered(400, 20, 16, 0.12) + [(5000 + k, "s", clustered(1)[0][2]) for k in range(150)] + [(9000, "s", [0.0] * 16), (9001, "u", [1.0, 2.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    groups = lambda links: {(r["id"], r["root"]) for r in vectors.components(links).collect()}
    assert groups(ann.near_links(frame, least)) == groups(vectors.near_links(frame, least))


def test_few_pairs_meet_where_vectors_have_structure(spark):
    rows = spark.createDataFrame(clustered(900, 30), SCHEMA)
    cells = ann.fitted(rows)
    placed = settled(ann.placed(rows, cells))
    for r in placed.where("cell >= 0").groupBy("cell").agg({"cosine": "min"}).collect():
        cells.least[r["cell"]] = r["min(cosine)"]
    met = ann.comparisons(ann.cell_meetings(placed, cells, 0.92, 64))
    assert met < 0.15 * 900 * 899 / 2


def test_vectors_without_structure_are_sent_to_few_groups(spark):
    """Sent to each cell, rows would be moved once for each of a number of cells that grows with the table."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, "s", v.tolist()) for k, v in enumerate(rng.standard_normal((900, 16)))], SCHEMA)
    cells = ann.fitted(rows)
    placed = settled(ann.placed(rows, cells))
    for r in placed.groupBy("cell").agg({"cosine": "min"}).collect():
        cells.least[r["cell"]] = r["min(cosine)"]
    groups, size = ann.neighbourhoods(placed, cells, 300)
    moved = ann.visits(placed, cells, 0.3, groups).groupBy("id").count().agg({"count": "max"}).first()[0]
    assert len(cells.spaces) > 25 and moved <= len(set(groups)) - 1 <= 5
    met = vectors.block_links(ann.cell_meetings(placed, cells, 0.3, 300), 0.3)
    root = lambda links: {r["id"]: r["root"] for r in vectors.components(links).collect()}
    assert root(met) == root(vectors.close_pairs(rows, 0.3))


def test_few_rows_meet_all_centres_at_once(spark):
    """Rows by centres is a matrix, and a batch has thousands of rows."""
    from unittest import mock

    cells, held = ann.Cells(["s"] * 2, [np.array([1.0, 0.0]), np.zeros(2)], np.ones(2)), []
    batches = spark.range(5000).selectExpr("id", "'s' AS space_id", "array(1.0D, id) AS vec").coalesce(1).toArrow().to_batches()
    with mock.patch.object(ann, "map_arrow", lambda df, run, schema: held.append([b.num_rows for b in run(iter(batches))])):
        frame = spark.range(0).selectExpr("id", "id AS qid", "'s' AS space_id", "array(1.0D) AS vec")
        ann.placed(frame, cells)
        ann.probes_of(frame, cells, 1)
    assert [sum(h) for h in held] == [5000, 5000] and max(map(max, held)) <= ann.PART_ROWS
