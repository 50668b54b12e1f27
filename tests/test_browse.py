import pytest

from lumenshelf.operators.filters import FIELDS, BadRequest, Filter, Visibility, apply_filters, visible
from lumenshelf.plans.browse import QueryRequest, decode_cursor, encode_cursor, page
from lumenshelf.registry.browse import by_field
from lumenshelf.sources.fixtures import Catalog


@pytest.fixture(scope="module")
def cat(spark, sf_dir):
    return Catalog(spark, sf_dir)


def test_every_field_builds(cat):
    """48 facets; the usage right is one of them and has four names here."""
    assert len(FIELDS) == len(set(FIELDS)) == 48 + 3
    simple = {"media_type": "image", "format": "png", "license": "unknown", "source": "src1", "tag": "texture", "path": "en/", "folder": "en/src1/", "favorite": True}
    for name in FIELDS:
        f = by_field(name)[0] if by_field(name) else Filter(name, "gt", 5) if name == "size_bytes" else Filter(name, "eq", simple.get(name, True))
        apply_filters(cat, cat.asset, [f]).schema


@pytest.mark.parametrize(
    "f",
    [
        Filter("size_bytes", "eq", 5), Filter("size_bytes", "gt", "5"), Filter("width", "contains", 5), Filter("width", "eq", True), Filter("has_rig", "ne", True), Filter("has_rig", "eq", 1), Filter("commercial", "gt", True),
        Filter("source", "eq", 3), Filter("tag", "gt", "x"), Filter("author", "contains", "x"), Filter("media_type", "in", []), Filter("width", "range", (1,)), Filter("nothing", "eq", "x"), Filter("path", "eq", 1), Filter("image_class", "ne", "x"),
    ],
)
def test_what_no_filter_takes(cat, f):
    with pytest.raises(BadRequest):
        apply_filters(cat, cat.asset, [f])


def test_unknown_rights_match_neither_side(cat):
    known = apply_filters(cat, cat.asset, [Filter("commercial", "eq", True)]).count() + apply_filters(cat, cat.asset, [Filter("commercial", "ne", True)]).count()
    assert known == cat.asset.where("commercial IS NOT NULL").count() < cat.asset.count()


@pytest.mark.parametrize("sort", ["name", "size", "scanned"])
@pytest.mark.parametrize("descending", [False, True])
def test_pages_walk_the_whole_order(cat, sort, descending):
    """Through nulls and ties, in both directions."""
    key = {"name": "filename", "size": "browse_size", "scanned": "scanned_at"}[sort]
    filters = [Filter("media_type", "eq", "document"), Filter("path", "eq", "en/src1")]
    whole = [r["id"] for r in page(cat, QueryRequest(filters=filters, sort=sort, descending=descending, limit=500)).collect()]
    walked, cursor = [], None
    while True:
        rows = page(cat, QueryRequest(filters=filters, sort=sort, descending=descending, after=cursor, limit=7)).collect()
        walked += [r["id"] for r in rows[:7]]
        if len(rows) <= 7:
            break
        cursor = encode_cursor(sort, descending, rows[6][key], rows[6]["id"])
    assert walked == whole and len(whole) > 7


def test_hostile_cursors():
    good = encode_cursor("size", False, 5, 7)
    assert decode_cursor(good, "size", False) == (5, 7)
    assert decode_cursor(encode_cursor("size", True, None, 7), "size", True) == (None, 7)
    for bad in ("", "b1.", "x", good + "=", good[:-2], "b1." + "A" * 5000, encode_cursor("size", True, 5, 7), encode_cursor("name", False, "a", 7), encode_cursor("size", False, "5", 7), encode_cursor("size", False, float("inf"), 7), encode_cursor("size", False, 5, True)):
        with pytest.raises(BadRequest):
            decode_cursor(bad, "size", False)


def test_visibility_never_leaks(cat):
    assert visible(cat, cat.asset, Visibility.only()).count() == 0
    both = visible(cat, cat.asset, Visibility.only(["src1"], [3]))
    ids = [r["id"] for r in both.collect()]
    assert len(ids) == len(set(ids))
    allowed = {r["id"] for r in cat.asset.where("source_id = 'src1'").collect()} | {r["asset_id"] for r in cat.collection_member.where("collection_id = 3").collect()}
    assert set(ids) == allowed
    assert {r["id"] for r in page(cat, QueryRequest(limit=500), Visibility.only(["src1"])).collect()} <= allowed
    assert visible(cat, cat.asset, Visibility()).count() == cat.asset.count()


def test_filters_reach_the_scan(cat):
    plan = cat.spark._jvm.PythonSQLUtils.explainString(apply_filters(cat, cat.asset, [Filter("source", "eq", "src1"), Filter("media_type", "eq", "document")]).select("id")._jdf.queryExecution(), "formatted")
    assert "EqualTo(source,src1)" in plan and "p_name" not in plan
