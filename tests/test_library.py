import pytest
from pyspark.sql import functions as F

from lumenshelf.operators.filters import BadRequest, Filter, Visibility
from lumenshelf.plans.browse import QueryRequest
from lumenshelf.plans.library import Library
from lumenshelf.registry.search import spaces
from lumenshelf.sources.fixtures import Catalog


@pytest.fixture(scope="module")
def cat(spark, sf_dir):
    return Catalog(spark, sf_dir)


CEILING = Visibility.only(["src1", "src2"], [3])


def test_no_method_shows_a_hidden_asset(cat):
    library = Library(cat, CEILING)
    seen = {r["id"] for r in library.assets.collect()}
    vecs = spaces(cat)
    for rows in (library.query(QueryRequest(limit=500)), library.query(QueryRequest(text="ring", limit=500)), library.grid(), library.manifest(), library.credits(), library.sidecars(), library.find_similar(vecs, min(seen), 50), library.hybrid("ring", vecs, None, "space-0")):
        assert {r["id"] for r in rows.collect()} <= seen
    assert library.stats().first()["n"] == len(seen)
    assert sum(r["n"] for r in library.by_media().collect()) == len(seen)
    hidden = cat.asset.where(~F.col("id").isin(sorted(seen))).first()["id"]
    assert library.get_asset(hidden).collect() == [] and library.find_similar(vecs, hidden, 5).collect() == []
    assert {r["source_id"] for r in library.sources().collect()} == {"src1", "src2"}
    assert {r["connection"] for r in library.sources().collect()} == {"<redacted>"}


def test_text_queries(cat):
    library = Library(cat)
    assert library.count(QueryRequest(text="ring")).first()["total"] == len(library.query(QueryRequest(text="ring", limit=500)).collect())
    only = library.query(QueryRequest(text="ring", filters=[Filter("media_type", "eq", "image")], limit=500)).collect()
    assert only and {r["tier"] for r in only} <= {0, 1, 2}
    with pytest.raises(BadRequest):
        library.query(QueryRequest(text="ring", descending=True))


def test_hybrid_prefers_what_both_lists_hold(cat):
    library, vecs = Library(cat), spaces(cat)
    vec = vecs.where("id = 5").first()["vec"]
    rows = library.hybrid("ring", vecs, vec, "space-0", limit=50).collect()
    assert rows == sorted(rows, key=lambda r: (-r["score"], r["filename"], r["id"]))
    assert len({r["id"] for r in rows}) == len(rows) > 10


def test_what_is_hidden_takes_no_place_in_a_hybrid_search(cat, monkeypatch):
    """The best word hits are all hidden; visible ones still fill the lists, and hidden ones seed nothing."""
    monkeypatch.setattr("lumenshelf.operators.vectors.LEXICAL_CAP", 5)
    monkeypatch.setattr("lumenshelf.operators.vectors.SEED_CAP", 5)
    best = [r["id"] for r in Library(cat).query(QueryRequest(text="the", limit=5)).collect()]
    sources = sorted({r["source_id"] for r in cat.asset.select("source_id").distinct().collect()} - {r["source_id"] for r in cat.asset.where(F.col("id").isin(best)).collect()})
    library, vecs = Library(cat, Visibility.only(sources, [])), spaces(cat)
    seen = {r["id"] for r in library.assets.collect()}
    visible_hits = min(5, len(library.query(QueryRequest(text="the", limit=5)).collect()))
    words = library.hybrid("the", vecs, None, "space-0").collect()
    assert len(words) == visible_hits > 0 and {r["id"] for r in words} <= seen
    # The same as a search of a catalogue without the hidden rows.
    vec = vecs.where("id = 5").first()["vec"]
    got = [(r["id"], r["score"]) for r in library.hybrid("the", vecs, vec, "space-0", "semantic").collect()]
    alone = [(r["id"], r["score"]) for r in library.hybrid("the", vecs.where(F.col("id").isin(sorted(seen))), vec, "space-0", "semantic").collect()]
    assert got == alone and {i for i, _ in got} <= seen
    assert Library(cat, Visibility.only([], [])).hybrid("the", vecs, vec, "space-0").collect() == []
