"""What analysis finds in decoded images and sounds, computed per row inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenshelf.functions.workers import in_parts, map_arrow

# Thresholds of the analysis.
SEAMLESS, REPEATS, WORK_EDGE = 0.86, 0.55, 256
FRAME, HOP, LOOP, FADE_FLOOR, TONAL, QUIETEST_DB = 2048, 512, 0.62, 0.35, 2.6, -100.0
PITCH_CLASSES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
SLOWEST, FASTEST = 50, 200


def resized(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas of a plane (height x width, with or without channels)."""

    def along(values: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
        edges = np.linspace(0, len(values), n + 1)
        low, part = np.floor(edges).astype(int), (edges % 1).reshape(-1, *[1] * (values.ndim - 1))
        at = total[low] + part * (total[np.minimum(low + 1, len(values))] - total[low])
        return (at[1:] - at[:-1]) * n / len(values)

    return np.moveaxis(along(np.moveaxis(along(plane, height), 0, 1), width), 0, 1)


def luminance(pixels: np.ndarray) -> np.ndarray:
    """Brightness, 0 to 255, of height x width x (1, 3 or 4) samples."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.float64)
    return pixels[:, :, :3] @ np.array([0.2126, 0.7152, 0.0722])


def difference_hash(light: np.ndarray) -> int:
    """64 bits, row by row from the lowest: whether a cell of the 9 x 8 reduction is brighter than the next; signed."""
    small = np.round(resized(light, 8, 9))
    return int(np.packbits(small[:, :-1] > small[:, 1:], bitorder="little").view(np.int64)[0])


def brightness_vector(light: np.ndarray) -> np.ndarray:
    """The 16 x 16 reduction less its mean, of length one; zeros for a flat image."""
    cells = np.round(resized(light, 16, 16)).ravel()
    cells -= cells.mean()
    norm = np.linalg.norm(cells)
    return cells / norm if norm > 1e-7 else np.zeros(256)


def main_colours(pixels: np.ndarray) -> list[str]:
    """Up to four colours as #rrggbb, commonest first: means of the cells of a cube with eight steps a channel."""
    rgb = np.repeat(pixels, 3, axis=2)[:, :, :3] if pixels.shape[2] < 3 else pixels[:, :, :3]
    scale = 48 / max(rgb.shape[:2])
    small = resized(rgb, max(1, round(rgb.shape[0] * scale)), max(1, round(rgb.shape[1] * scale))) if scale < 1 else rgb
    flat = np.round(small.reshape(-1, 3)).astype(np.int64)
    cells = (flat >> 5) @ np.array([64, 8, 1])
    counts = np.bincount(cells, minlength=512)
    first = np.argsort(-counts, kind="stable")[:4]
    means = [np.bincount(cells, flat[:, k], 512)[first] // np.maximum(counts[first], 1) for k in range(3)]
    return [f"#{int(r):02x}{int(g):02x}{int(b):02x}" for r, g, b, n in zip(*means, counts[first]) if n]


def period(signal: np.ndarray) -> int | None:
    """The lag of the strongest self-similarity of a line of means, if it is strong."""
    n = len(signal)
    rest = signal - signal.mean()
    power = float((rest * rest).sum())
    if n < 8 or power < 1e-6:
        return None
    spectrum = np.fft.rfft(rest, 2 * n)
    likeness = np.fft.irfft(spectrum * np.conj(spectrum))[2 : n // 2] / power
    best = int(np.argmax(likeness)) if len(likeness) else 0
    return best + 2 if len(likeness) and likeness[best] >= REPEATS else None


def tiling(light: np.ndarray) -> tuple[float, int | None, str]:
    """How well opposite edges meet (0 to 1), the period if the image repeats, and the class."""
    longest = max(light.shape)
    if longest > WORK_EDGE:
        light = resized(light, max(1, light.shape[0] * WORK_EDGE // longest), max(1, light.shape[1] * WORK_EDGE // longest))
    if min(light.shape) < 2:
        return 0.0, None, "non_tiling"
    c = np.round(light) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    seam = (np.abs(linear[:, 0] - linear[:, -1]).mean() + np.abs(linear[0] - linear[-1]).mean()) / 2
    steps = np.concatenate([np.abs(np.diff(linear, axis=k)).ravel() for k in (0, 1)])
    score = float(np.clip(2 - seam / (steps.mean() + 1e-4), 0, 1))
    lag = period(linear.mean(axis=0)) or period(linear.mean(axis=1))
    repeats = round(lag * longest / max(light.shape)) if lag else None
    return score, repeats, "tiled" if repeats else "seamless" if score >= SEAMLESS else "non_tiling"


def image_features(pixels: np.ndarray) -> dict:
    """All that is found in an image of height x width x channels."""
    light, colours = luminance(pixels), main_colours(pixels)
    score, repeats, tile_class = tiling(light)
    short, long = sorted(pixels.shape[:2])
    kind = "texture" if short / long > 0.8 and score >= SEAMLESS else "sprite" if pixels.shape[2] in (2, 4) and len(colours) <= 3 else "photo"
    return {"phash": difference_hash(light), "tileability": score, "repeat_period": repeats, "tile_class": tile_class, "colours": colours, "class": kind, "vec": brightness_vector(light).tolist()}


IMAGE = "id long, phash long, tileability double, repeat_period int, tile_class string, colours array<string>, class string, vec array<double>"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images below a path by Spark's own reader, in rows for image_table; what cannot be decoded is left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return rows.select(F.xxhash64("origin").alias("id"), "origin", "height", "width", F.col("nChannels").alias("channels"), "data", F.lit(True).alias("bgr"))


def image_table(images: DataFrame) -> DataFrame:
    """Features of rows (id, height, width, channels, data, bgr): samples row by row, bgr if blue comes first.
    Rows whose samples do not fit their size have no features."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(IMAGE)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in in_parts(batches):
            out = []
            for row in batch.to_pylist():
                size = (row["height"] or 0, row["width"] or 0, row["channels"] or 0)
                if min(size) > 0 and len(row["data"] or b"") == size[0] * size[1] * size[2]:
                    pixels = np.frombuffer(row["data"], np.uint8).reshape(size)
                    if row["bgr"] and size[2] >= 3:
                        pixels = pixels[:, :, [2, 1, 0, *range(3, size[2])]]
                    out.append({"id": row["id"]} | image_features(pixels))
                else:
                    out.append({"id": row["id"]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return map_arrow(images.select("id", "height", "width", "channels", "data", "bgr"), run, IMAGE)


# Sound


def frames_of(samples: np.ndarray) -> np.ndarray:
    """Overlapping windowed frames; a short sound is padded to one."""
    padded = np.pad(samples, (0, max(0, FRAME - len(samples))))
    return np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP] * np.hanning(FRAME)


def tempo(flux: np.ndarray, rate: float) -> float | None:
    """Beats a minute from the self-similarity of the onset curve, between SLOWEST and FASTEST; none if it is weak."""
    # Smoothed, so that beats which fall between two frames still meet.
    rest = np.convolve(flux - flux.mean(), [0.1, 0.2, 0.4, 0.2, 0.1], "same")
    power = float((rest * rest).sum())
    low, high = int(np.ceil(60 * rate / FASTEST)), int(60 * rate / SLOWEST)
    if power < 1e-9 or len(flux) < 2 * low or low < 1:
        return None
    likeness = np.array([(rest[:-lag] * rest[lag:]).sum() / power for lag in range(low, min(high, len(flux) - 1) + 1)])
    if not len(likeness) or likeness.max() <= 0.2:
        return None
    # Whole bars are as alike as beats: of lags nearly as good the shortest counts, at its peak.
    at = int(np.argmax(likeness >= 0.75 * likeness.max()))
    while at + 1 < len(likeness) and likeness[at + 1] > likeness[at]:
        at += 1
    return 60 * rate / (low + at)


def sound_features(samples: np.ndarray, rate: int) -> dict:
    """All that is found in a mono sound of samples from -1 to 1."""
    x = np.asarray(samples, np.float64)
    seconds = len(x) / rate
    strength = np.abs(np.fft.rfft(frames_of(x), axis=1))
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    rise = np.maximum(np.diff(strength, axis=0, prepend=0), 0).sum(axis=1)
    onsets = int(((rise > rise.mean() + 1.5 * rise.std()) & (np.append(True, rise[1:] > rise[:-1])) & (np.append(rise[:-1] >= rise[1:], True))).sum()) if rise.max() > 1e-9 else 0
    heard = (hertz >= 40) & (hertz <= 5000)
    pitch = np.round(12 * np.log2(hertz[heard] / 440) + 69).astype(int) % 12
    chroma = np.bincount(pitch, strength[:, heard].sum(axis=0), 12)
    tonal = bool(chroma.sum() > 1e-9 and chroma.max() >= TONAL * chroma.mean())
    beats = tempo(rise, rate / HOP)
    block = max(1, len(x) // 20)
    levels = np.sqrt(np.add.reduceat(x * x, np.arange(0, len(x), block)) / block) if len(x) else np.zeros(1)
    sustained = bool(levels.max() > 1e-9 and np.median(levels) > FADE_FLOOR * levels.max())
    edge = [np.sqrt((part * part).mean()) if len(part) else 0.0 for part in (x[:block], x[-block:])]
    alike = min(edge) / max(edge) if max(edge) > 1e-9 else 0.0
    first, last = strength[0], strength[-1]
    norms = np.linalg.norm(first) * np.linalg.norm(last)
    seamless = float(alike * (first @ last / norms)) if norms > 1e-12 else 0.0
    is_loop = sustained and seamless >= LOOP
    short = not sustained and seconds < 1.5
    if is_loop:
        kind = "loop"
    elif short and onsets <= 1:
        kind = "one_shot"
    elif tonal and (beats is not None or sustained and seconds >= 4):
        kind = "music"
    else:
        kind = "one_shot" if short else "sfx"
    loudness = float(20 * np.log10(max(np.sqrt((x * x).mean()), 1e-5))) if len(x) else QUIETEST_DB
    # Means over the frames that sound at all: where the middle of the spectrum lies, and how far it is from even noise.
    loud = strength[strength.sum(axis=1) > 1e-6]
    brightness = float((loud @ np.arange(len(hertz)) / loud.sum(axis=1) / (len(hertz) - 1)).mean()) if len(loud) else 0.0
    evenness = float((np.exp(np.log(loud + 1e-9).mean(axis=1)) / loud.mean(axis=1)).mean()) if len(loud) else 1.0
    return {"duration_s": seconds, "onsets": onsets, "bpm": beats, "musical_key": PITCH_CLASSES[int(np.argmax(chroma))] if tonal else None, "is_loop": is_loop, "class": kind, "loudness_db": loudness, "brightness": brightness, "harmonicity": min(max(1 - evenness, 0.0), 1.0), "loopability": min(max(seamless, 0.0), 1.0)}


SOUND = "id long, duration_s double, onsets int, bpm double, musical_key string, is_loop boolean, class string, loudness_db double, brightness double, harmonicity double, loopability double"


def sound_table(sounds: DataFrame) -> DataFrame:
    """Features of rows (id, rate, data): 16-bit little-endian mono samples. Empty sounds and those without a
    rate have none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(SOUND)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in in_parts(batches):
            out = []
            for row in batch.to_pylist():
                data = row["data"] or b""
                samples = np.frombuffer(data[: len(data) // 2 * 2], "<i2") / 32768
                out.append({"id": row["id"]} | (sound_features(samples, row["rate"]) if len(samples) and row["rate"] else {}))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return map_arrow(sounds.select("id", "rate", "data"), run, SOUND)
