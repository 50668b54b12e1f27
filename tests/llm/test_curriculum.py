import re
from collections import defaultdict

import pytest

from lumenshelf.llm import curriculum
from lumenshelf.llm.queries import op4_mix_sources


def slow_targets(sizes):
    """Resharing round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


def sources(n):
    return [(i, "w " * (i * 7 % 23 + 1), "en", ["a", "b", "c", "ü", None][i * i % 5]) for i in range(n)]


def test_targets_and_taken(make_docs):
    rows = sources(400) + [(1000 + i, "few words here", "en", "tiny") for i in range(3)]
    plan = curriculum.mix_plan(make_docs(rows)).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = slow_targets(sizes)
    taken, target = defaultdict(int), {}
    for r in plan:
        s = None if r["_sk"] == "n" else r["_sk"][1:]
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 and r["source_size"] == sizes[s]
        taken[s] += r["taken"]
        target[s] = r["target"]
    assert target == pytest.approx(want)
    for s in want:
        assert want[s] - 23 < taken[s] <= want[s] + 1e-6


def test_schedules_integrate_and_invert(spark):
    from pyspark.sql import functions as F

    assert [curriculum.integrals(k)[-1] for k in curriculum.SCHEDULES] == [1.0, 2.0, 3.0]
    knots = ((0.0, 0.0), (0.25, 2.0), (1.0, 1.0))
    total = curriculum.integrals(knots)[-1]
    got = spark.range(101).select(curriculum.inverse_demand(knots, F.col("id") / 100).alias("t")).collect()
    for k, r in enumerate(got):
        t = r["t"]
        mass = 4 * t * t if t <= 0.25 else 0.25 + (t - 0.25) * (2 + (2 - (t - 0.25) / 0.75)) / 2
        assert mass / total == pytest.approx(k / 100, abs=1e-9)


def test_sequence_is_sorted_and_whole(make_docs):
    docs = make_docs(sources(60))
    out = curriculum.training_sequence(docs, position_col="place")
    rows = out.collect()
    assert out.columns == [*docs.columns, "place"]
    assert [r["place"] for r in rows] == sorted(r["place"] for r in rows) and 0 <= rows[0]["place"] <= rows[-1]["place"] <= 1
    plan = curriculum.mix_plan(docs)
    assert len(rows) == plan.groupBy().sum("copies").first()[0]
    assert rows == curriculum.training_sequence(docs, position_col="place").collect()


def test_odd_rows(make_docs, odd_rows, spark, tmp_path):
    make_docs(odd_rows).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op4_mix_sources(spark, str(tmp_path)).collect()
    assert len(rows) == len(odd_rows)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert curriculum.training_sequence(make_docs([])).collect() == []


def test_oracle(spark, tmp_path, make_docs):
    import duckdb

    from lumenshelf.llm.queries import ORACLES

    make_docs(sources(300)).write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_mix_sources(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLES['op4_mix_sources']})").fetchall()
    assert [tuple(r) for r in sorted(got)] == [pytest.approx(w) for w in sorted(want)]
