"""Browse requests: filters, search, order, keyset pages and their cursors."""

from __future__ import annotations

import base64
import json
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenshelf.operators.filters import BadRequest, Filter, Visibility, apply_filters, visible
from lumenshelf.sources.fixtures import Catalog

SORTS = {"name": "filename", "size": "browse_size", "scanned": "scanned_at"}
MAX_LIMIT = 500
CURSOR = "b1."


@dataclass(frozen=True)
class QueryRequest:
    text: str | None = None
    filters: list[Filter] = field(default_factory=list)
    sort: str = "name"
    descending: bool = False
    after: str | None = None
    limit: int = 100


def browse_size() -> Column:
    """The size shown and sorted by: with dependencies; unknown stays unknown."""
    return (F.col("size_bytes") + F.coalesce("dependency_bytes", F.lit(0))).alias("browse_size")


def encode_cursor(sort: str, descending: bool, key: Any, last_id: int) -> str:
    body = json.dumps([1, sort, descending, key, last_id], separators=(",", ":"))
    return CURSOR + base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(cursor: str, sort: str, descending: bool) -> tuple[Any, int]:
    """Key and id of a cursor. It must be one that encode_cursor writes for the same order."""
    try:
        if not cursor.startswith(CURSOR) or len(cursor) > 4096:
            raise ValueError("form")
        raw = cursor[len(CURSOR) :]
        version, of, direction, key, last_id = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
        fits = isinstance(key, (str, type(None)) if sort == "name" else (int, float, type(None))) and not isinstance(key, bool)
        if version != 1 or (of, direction) != (sort, descending) or type(last_id) is not int or not fits:
            raise ValueError("content")
        if isinstance(key, float) and not math.isfinite(key) or encode_cursor(sort, descending, key, last_id) != cursor:
            raise ValueError("not canonical")
        return key, last_id
    except (ValueError, TypeError, UnicodeDecodeError) as e:
        raise BadRequest(f"bad cursor: {e}") from e


def order(key: str, descending: bool) -> list[Column]:
    """Key then id, both in one direction: nulls first when ascending, last when descending."""
    return [F.col(key).desc_nulls_last(), F.col("id").desc()] if descending else [F.col(key).asc_nulls_first(), F.col("id").asc()]


def after(key: str, descending: bool, value: Any, last_id: int) -> Column:
    """Rows behind (value, last_id) in ``order``. The bound on the key alone is for the scan."""
    k, i = F.col(key), F.col("id")
    if descending:
        if value is None:
            return k.isNull() & (i < last_id)
        return k.isNull() | ((k <= F.lit(value)) & ((k < F.lit(value)) | (i < last_id)))
    if value is None:
        return k.isNotNull() | (i > last_id)
    return (k >= F.lit(value)) & ((k > F.lit(value)) | (i > last_id))


def selected(cat: Catalog, request: QueryRequest, ceiling: Visibility = Visibility()) -> DataFrame:
    """All assets that a request describes, before order and page."""
    assets = apply_filters(cat, visible(cat, cat.asset, ceiling), request.filters)
    return assets.withColumn("browse_size", browse_size())


def page(cat: Catalog, request: QueryRequest, ceiling: Visibility = Visibility()) -> DataFrame:
    """One page in order, plus one row that tells whether more follow."""
    key = SORTS.get(request.sort)
    if key is None:
        raise BadRequest(f"no order by {request.sort}")
    rows = selected(cat, request, ceiling)
    if request.after:
        rows = rows.where(after(key, request.descending, *decode_cursor(request.after, request.sort, request.descending)))
    return rows.orderBy(*order(key, request.descending)).limit(min(max(request.limit, 1), MAX_LIMIT) + 1)


def total(cat: Catalog, request: QueryRequest, ceiling: Visibility = Visibility()) -> DataFrame:
    return selected(cat, request, ceiling).agg(F.count(F.lit(1)).alias("total"))


def saved_query(saved: str) -> QueryRequest:
    """A smart collection's query from its JSON: text, filters (field, op, value), sort and descending."""
    try:
        body = json.loads(saved)
        if not isinstance(body, dict) or set(body) - {"text", "filters", "sort", "descending"}:
            raise ValueError("keys")
        filters = [Filter(f["field"], f["op"], f["value"]) for f in body.get("filters", [])]
        request = QueryRequest(body.get("text"), filters, body.get("sort", "name"), body.get("descending", False))
        if request.sort not in SORTS or not isinstance(request.descending, bool) or not isinstance(request.text, (str, type(None))):
            raise ValueError("order")
        return request
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise BadRequest(f"bad saved query: {e}") from e


def smart_members(cat: Catalog, saved: str, ceiling: Visibility = Visibility()) -> DataFrame:
    """The visible assets that a smart collection's query selects now. A query that cannot be read, or is
    refused, selects nothing: what it once hid must not show."""
    try:
        request = saved_query(saved)
        return selected(cat, request, ceiling)
    except BadRequest:
        return cat.asset.where(F.lit(False))
