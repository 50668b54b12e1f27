"""Features that analysis derives: classes, statistic vectors, file name tags, text descriptors, sound and image."""

from __future__ import annotations

import re
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.workers import map_arrow

TEXT_DIMENSIONS, LEAST_TOKEN_BYTES = 256, 3
TOKEN = re.compile(r"[^\W_]+")


def model_class(triangles: Column) -> Column:
    return F.when(triangles < 2_000, "prop_lowpoly").when((triangles < 50_000) | triangles.isNull(), "prop").otherwise("prop_highpoly")


def video_class(duration_ms: Column) -> Column:
    return F.when(duration_ms < 5_000, "sting").when((duration_ms < 60_000) | duration_ms.isNull(), "clip").otherwise("cutscene")


def video_tags(width: Column, height: Column, has_audio: Column) -> Column:
    size = F.when((width >= 3840) | (height >= 2160), F.lit("4k")).when((width >= 1920) | (height >= 1080), F.lit("1080p"))
    return F.array_compact(F.array(F.when(has_audio == F.lit(False), F.lit("silent")), size))


def text_class(path: Column, text: Column) -> Column:
    """What a document is to a project, by its name first and then by its beginning."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))
    head = F.lower(F.substring(text, 1, 600))
    has = lambda c, *words: F.greatest(*[c.contains(w) for w in words], F.lit(False))
    return (
        F.when(has(stem, "licen", "copying", "eula"), "license").when(has(stem, "readme"), "readme").when(has(stem, "changelog", "changes"), "changelog").when(has(stem, "invoice", "receipt", "order"), "receipt")
        .when(F.coalesce(has(head, "permission is hereby granted", "all rights reserved", "licensed under"), F.lit(False)), "license").otherwise("document")
    )


def unit(values: list[Column]) -> Column:
    """A vector of length one; zero stays."""
    norm = F.sqrt(sum((v * v for v in values[1:]), values[0] * values[0]))
    return F.array(*[F.when(norm > 1e-7, v / norm).otherwise(v) for v in values])


def or_zero(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]


def audio_vector() -> Column:
    duration, rate, channels, depth = or_zero("duration_ms", "sample_rate", "channels", "bit_depth")
    return unit([F.log10(1 + duration / 1000), rate / 48_000, channels / 2, depth / 24])


def model_vector() -> Column:
    vertices, triangles, meshes, materials, textures, rig, animation, uv = or_zero("vertex_count", "triangle_count", "mesh_count", "material_count", "texture_count", "has_rig", "has_animation", "has_uv")
    return unit([F.log10(1 + vertices), F.log10(1 + triangles), F.log10(1 + meshes), materials / 8, textures / 8, rig, animation, uv])


def video_vector() -> Column:
    duration, width, height, fps, bitrate, audio = or_zero("duration_ms", "width", "height", "fps", "bitrate", "has_audio")
    return unit([F.log10(1 + duration / 1000), F.log10(1 + width), F.log10(1 + height), fps / 60, F.log10(1 + bitrate) / 8, audio])


def filename_tags(assets: DataFrame) -> DataFrame:
    """Words of file names as tag suggestions: three bytes or more, not all digits, not the format."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("filename"), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))))
    rows = assets.select("id", "format", words.alias("name"))
    return rows.where((F.octet_length("name") >= 3) & (F.col("name") != F.lower("format")) & ~F.col("name").rlike("^[0-9]+$")).select("id", "name", F.lit(0.4).alias("confidence"))


def excerpt(text: Column, chars: int = 280) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > chars, F.concat(F.rtrim(F.substring(flat, 1, chars)), F.lit("…"))).otherwise(flat)


@lru_cache(maxsize=200_000)
def fnv1a(token: str) -> int:
    """64-bit FNV-1a of the token's UTF-8."""
    value = 0xCBF29CE484222325
    for byte in token.encode():
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def text_descriptor(text: str | None) -> list[float] | None:
    """Hashed bag of words with damped counts, length one; None for texts without a token."""
    counts: dict[int, int] = {}
    for token in TOKEN.findall(text or ""):
        if len(token.encode()) >= LEAST_TOKEN_BYTES:
            slot = fnv1a(token.lower()) % TEXT_DIMENSIONS
            counts[slot] = counts.get(slot, 0) + 1
    if not counts:
        return None
    vector = np.zeros(TEXT_DIMENSIONS)
    for slot, n in counts.items():
        vector[slot] = 1 + log(n)
    return (vector / np.linalg.norm(vector)).astype(np.float32).tolist()


def text_vectors(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, space_id and vec of the texts that have a descriptor."""

    def run(batches):
        for batch in batches:
            found = [(i, v) for i, t in zip(*[c.to_pylist() for c in batch.columns]) if (v := text_descriptor(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array(["text-hash-v1"] * len(found), pa.string()), pa.array([v for _, v in found], pa.list_(pa.float32()))], ["id", "space_id", "vec"])

    return map_arrow(rows.select(id_col, text_col), run, "id long, space_id string, vec array<float>")


#: How far the strongest pitch class stands above the mean in tonal sound.
TONAL_RATIO = 2.6


def peaks(samples: np.ndarray, buckets: int = 256) -> list[float]:
    """Greatest amplitude per bucket, as a share of the greatest of all."""
    if not len(samples):
        return []
    edges = np.arange(buckets) * len(samples) // buckets
    tops = np.maximum.reduceat(np.abs(samples.astype(np.float64)), np.minimum(edges, len(samples) - 1))
    return (tops / tops.max()).tolist() if tops.max() > 0 else tops.tolist()


def peak_rows(rows: DataFrame, buckets: int = 256) -> DataFrame:
    """id and peaks of rows (id, samples: array of numbers)."""

    def run(batches):
        for batch in batches:
            found = [peaks(np.array(x if x is not None else [], np.float64), buckets) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["id", "peaks"])

    return map_arrow(rows.select("id", "samples"), run, "id long, peaks array<double>")


def dominant_pitch(chroma_rows: DataFrame, ratio: float = TONAL_RATIO) -> DataFrame:
    """The strongest pitch class of rows (id, pitch, energy), the higher of equals; null where it does not stand
    ``ratio`` times above the mean of the twelve."""
    total, top = F.sum("energy"), F.max("energy")
    strongest = F.max_by("pitch", F.struct("energy", "pitch"))
    return chroma_rows.groupBy("id").agg(F.when((total > 0) & (top >= ratio * total / 12), strongest).alias("pitch"))
