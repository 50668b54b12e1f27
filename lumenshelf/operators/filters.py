"""Facet filters: each a predicate on assets, or a semi join with the assets that a side table names."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.text import nocase
from lumenshelf.sources.fixtures import Catalog


class BadRequest(ValueError):
    """A combination of field, operator and value that no filter accepts."""


@dataclass(frozen=True)
class Filter:
    """field, op (eq ne lt lte gt gte in range contains) and a value: str, number, bool, pair or list."""

    field: str
    op: str
    value: Any


COLUMN_FIELDS = {"media_type": "media_type", "format": "format", "license": "license_status"}
RIGHTS = ("commercial", "modify", "redistribute", "attribution")
# Attribute fields by kind, with the tables and column that hold them.
NUMBERS = {
    "width": (("image_attr", "video_attr"), "width"), "height": (("image_attr", "video_attr"), "height"), "duration": (("audio_attr", "video_attr"), "duration_ms"),
    "color_depth": (("image_attr",), "color_depth"), "tileability": (("image_attr",), "tileability"),
    "bpm": (("audio_attr",), "bpm"), "sample_rate": (("audio_attr",), "sample_rate"), "bit_depth": (("audio_attr",), "bit_depth"), "channels": (("audio_attr",), "channels"),
    "loudness": (("audio_attr",), "loudness_lufs"), "brightness": (("audio_attr",), "brightness"), "harmonicity": (("audio_attr",), "harmonicity"),
    "tri_count": (("model_attr",), "triangle_count"), "vertex_count": (("model_attr",), "vertex_count"), "mesh_count": (("model_attr",), "mesh_count"),
    "material_count": (("model_attr",), "material_count"), "texture_count": (("model_attr",), "texture_count"), "dependency_bytes": (("model_attr",), "dependency_bytes"),
    "fps": (("video_attr",), "fps"), "bitrate": (("video_attr",), "bitrate"), "page_count": (("document_attr",), "page_count"), "word_count": (("document_attr",), "word_count"),
}
STRINGS = {"color_space": ("image_attr", "color_space"), "tile_class": ("image_attr", "tile_class"), "musical_key": ("audio_attr", "musical_key"), "codec": ("audio_attr", "codec"), "container": ("audio_attr", "container"), "author": ("document_attr", "author")}
BOOLEANS = {"has_alpha": ("image_attr", "has_alpha"), "has_rig": ("model_attr", "has_rig"), "has_animation": ("model_attr", "has_animation"), "has_uv": ("model_attr", "has_uv"), "has_audio": ("video_attr", "has_audio")}
CLASSES = {"image_class": "image_attr", "audio_class": "audio_attr", "model_class": "model_attr", "video_class": "video_attr", "document_class": "document_attr"}
FIELDS = (*COLUMN_FIELDS, "source", "size_bytes", *RIGHTS, "tag", "favorite", "path", "folder", *NUMBERS, *STRINGS, *BOOLEANS, *CLASSES)


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def bad(f: Filter) -> BadRequest:
    return BadRequest(f"{f.field} does not take {f.op} {f.value!r}")


def compared(column: Column, f: Filter, equal: bool, whole: bool = False) -> Column:
    """A numeric comparison; null never matches. whole cuts the bounds to integers."""
    of = (lambda x: F.lit(int(x))) if whole else (lambda x: F.lit(float(x)))
    if f.op == "range" and isinstance(f.value, (tuple, list)) and len(f.value) == 2 and all(map(is_number, f.value)):
        return column.between(of(f.value[0]), of(f.value[1]))
    tests = {"lt": column.__lt__, "lte": column.__le__, "gt": column.__gt__, "gte": column.__ge__} | ({"eq": column.__eq__} if equal else {})
    if f.op not in tests or not is_number(f.value):
        raise bad(f)
    return tests[f.op](of(f.value))


def listed(f: Filter, also: tuple[str, ...] = ()) -> list[str]:
    """The strings of eq (or another single-valued operator) and in."""
    if f.op in ("eq", *also) and isinstance(f.value, str):
        return [f.value]
    if f.op == "in" and isinstance(f.value, (list, tuple)) and f.value and all(isinstance(v, str) for v in f.value):
        return list(f.value)
    raise bad(f)


def one_of(column: Column, values: list[str]) -> Column:
    """Equal to one of the values, ASCII case aside."""
    return nocase(column).isin([v.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for v in values])


def predicate(f: Filter) -> Column | None:
    """The filter as a predicate on asset columns, or None if a side table answers it."""
    if f.field in COLUMN_FIELDS:
        return F.col(COLUMN_FIELDS[f.field]).isin(listed(f))
    if f.field == "source":
        if not isinstance(f.value, str):
            raise bad(f)
        return F.col("source_id") == f.value
    if f.field == "size_bytes":
        return compared(F.col("size_bytes"), f, equal=False, whole=True)
    if f.field in RIGHTS:
        if f.op not in ("eq", "ne") or not isinstance(f.value, bool):
            raise bad(f)
        return F.col(f.field) == F.lit(f.value == (f.op == "eq"))
    if f.field == "favorite":
        marked = F.col("flags").bitwiseAND(2) != 0
        return ~marked if f.value is False else marked
    if f.field in ("path", "folder"):
        if not isinstance(f.value, str):
            raise bad(f)
        return path_prefix(f.value) if f.field == "path" else in_folder(f.value)
    return None


def path_prefix(prefix: str) -> Column:
    """The path begins with the prefix, ASCII case aside; an empty prefix matches all."""
    return F.lit(True) if not prefix else nocase(F.col("path")).startswith(nocase(F.lit(prefix)))


def in_folder(folder: str) -> Column:
    """Directly in the folder: no further directory behind the prefix. Empty: the root's files."""
    return path_prefix(folder) & ~F.substring(F.col("path"), len(folder) + 1, 1 << 30).contains("/")


def side_table(cat: Catalog, f: Filter) -> DataFrame:
    """The asset ids that a filter on tags or attributes allows (column asset_id, maybe repeated)."""
    if f.field == "tag":
        tags = cat.tag.where(one_of(F.col("name"), listed(f, ("contains",))))
        return cat.asset_tag.where("state = 'confirmed'").join(tags, "tag_id").select("asset_id")
    if f.field in NUMBERS:
        tables, column = NUMBERS[f.field]
        parts = [getattr(cat, t).where(compared(F.col(column), f, equal=True)).select("asset_id") for t in tables]
        return reduce(DataFrame.unionByName, parts)
    if f.field in STRINGS:
        table, column = STRINGS[f.field]
        return getattr(cat, table).where(one_of(F.col(column), listed(f))).select("asset_id")
    if f.field in BOOLEANS:
        if f.op != "eq" or not isinstance(f.value, bool):
            raise bad(f)
        table, column = BOOLEANS[f.field]
        return getattr(cat, table).where(F.col(column) == F.lit(f.value)).select("asset_id")
    if f.field in CLASSES:
        tags = cat.tag.where(one_of(F.col("name"), listed(f)))
        confirmed = cat.asset_tag.where("state = 'confirmed'").join(tags, "tag_id").select("asset_id")
        return confirmed.join(getattr(cat, CLASSES[f.field]), "asset_id", "left_semi")
    raise BadRequest(f"unknown field {f.field}")


def apply_filters(cat: Catalog, assets: DataFrame, filters: list[Filter]) -> DataFrame:
    """The assets that pass all filters. Predicates come first, so that they reach the scan."""
    for f in filters:
        if (test := predicate(f)) is not None:
            assets = assets.where(test)
    for f in filters:
        if predicate(f) is None:
            assets = assets.join(side_table(cat, f).withColumnRenamed("asset_id", "id"), "id", "left_semi")
    return assets


@dataclass(frozen=True)
class Visibility:
    """What a caller may see: everything, or the assets of some sources and collections."""

    full: bool = True
    sources: frozenset[str] = field(default_factory=frozenset)
    collections: frozenset[int] = field(default_factory=frozenset)

    @staticmethod
    def only(sources=(), collections=()) -> Visibility:
        return Visibility(False, frozenset(sources), frozenset(collections))


def visible(cat: Catalog, assets: DataFrame, ceiling: Visibility) -> DataFrame:
    """Assets under the ceiling, each once; an empty ceiling shows nothing."""
    if ceiling.full:
        return assets
    by_source = F.col("source_id").isin(sorted(ceiling.sources)) if ceiling.sources else F.lit(False)
    if not ceiling.collections:
        return assets.where(by_source)
    members = cat.collection_member.where(F.col("collection_id").isin(sorted(ceiling.collections))).select(F.col("asset_id").alias("id"), F.lit(True).alias("_member")).distinct()
    return assets.join(members, "id", "left").where(by_source | F.col("_member").isNotNull()).select(*assets.columns)


def not_blocked(cat: Catalog, assets: DataFrame) -> DataFrame:
    return assets.join(cat.blocklist, "content_hash", "left_anti").select(*assets.columns)


def not_pending(cat: Catalog, assets: DataFrame) -> DataFrame:
    return assets.join(cat.pending_ingest, ["source_id", "path"], "left_anti").select(*assets.columns)
