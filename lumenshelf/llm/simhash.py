"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.workers import map_arrow
from lumenshelf.llm.common import cut, given_back, id_key, join_groups, map_rows, set_apart, sized
from lumenshelf.llm.graph import connected_components

BITS, SHINGLE, SEED, RADIUS = 64, 4, 42, 4
#: Fingerprints of a bucket that are compared with each other in one task; larger buckets go another way.
BUCKET_ROWS = 2048


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text as a signed 64-bit number; no words give zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 1 << 16):
        octets = values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.int64)[0])


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` bits are all outside at least one mask.

    Bit i carries the vector of its low radius + 1 binary digits, and mask v holds the bits whose
    vector has an odd product with v. The vectors of ``radius`` bits span less than the whole space,
    so some v has even products with all of them. Each mask holds half of the bits.
    """
    return [signed(sum(1 << i for i in range(BITS) if (i & v).bit_count() % 2)) for v in range(1, 1 << (radius + 1))]


def links_within(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Enough links among the fingerprints of one bucket to connect all that lie within the radius."""
    bits = prints.view(np.uint64)  # of signed numbers numpy counts the bits of the magnitude
    label = np.arange(len(prints))
    for at in range(0, len(prints), 256):
        i, j = np.nonzero(np.bitwise_count(bits[at : at + 256, None] ^ bits[None, at:]) <= radius)
        i, j = i + at, j + at
        while (label[i] != label[j]).any():
            low, new = np.minimum(label[i], label[j]), label.copy()
            # The labels themselves move too, so that a strip joins what earlier strips have linked.
            for of in (i, j, label[i], label[j]):
                np.minimum.at(new, of, low)
            while (new != new[new]).any():
                new = new[new]
            label = new
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """Links within buckets, each an array of fingerprints of bounded length."""

    def run(batches):
        for batch in batches:
            buckets = batch.column(0)
            for at in range(0, batch.num_rows, 500):
                found = [links_within(buckets[k].values.to_numpy(), radius) for k in range(at, min(at + 500, batch.num_rows))]
                a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return map_arrow(buckets.select("prints"), run, "a long, b long")


def ball_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links among the fingerprints of crowded buckets, without comparing pairs.

    Two fingerprints lie within an even radius exactly if some value lies within half of it of both.
    So each is tied to every value of its ball (2,081 for radius 4), and all that share a value to the
    least of them: work in proportion to their number.
    """
    flips = [0] + [1 << i for i in range(BITS)]
    if radius == 4:
        flips += [1 << i | 1 << j for i in range(BITS) for j in range(i)]
    masks = np.array(flips, np.uint64).view(np.int64)

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 64):
                part = values[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(masks))), pa.array((part[:, None] ^ masks[None, :]).ravel())], ["fp", "value"])

    balls = map_arrow(prints.select("fp"), run, "fp long, value long")
    least = balls.groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top")
    return balls.join(least, "value").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_links(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within the radius.

    Every fingerprint goes to one bucket per covering mask. Buckets of two are compared in place;
    those up to ``bucket_rows`` as one array; the fingerprints of larger ones by ball_links. A bucket
    links only fingerprints that some chain within the radius joins, so components are exact.
    """
    if radius not in (2, 4):
        raise ValueError("crowded buckets are linked for radius 2 and 4 alone")
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    rows = prints.select("fp", F.posexplode(masks).alias("mask", "bits")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"))
    sizes = cut(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    more, _ = sized(sizes.where("n > 2").select("mask", "key", "n"))
    in_more = rows.join(more, ["mask", "key"])
    buckets = in_more.where(F.col("n") <= bucket_rows).groupBy("mask", "key").agg(F.collect_list("fp").alias("prints"))
    crowded = cut(in_more.where(F.col("n") > bucket_rows).select("fp").distinct())
    links = pairs.unionByName(bucket_links(buckets, radius))
    if not crowded.isEmpty():
        links = links.unionByName(ball_links(crowded, radius))
    return links.distinct()


def placed_rows(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """One row per row: id, fp, hash (of the text), component_id, and keep: the least (no id, id, fp, hash)
    of the component, which names the document that stays."""

    def start():
        return lambda doc, text: (doc, fingerprint(text), signed(xxhash.xxh64_intdigest((text or "").encode(), SEED)))

    rows = cut(map_rows(docs, start, f"{id_col} long, fp long, hash long", [id_col, text_col]))
    prints = cut(rows.groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "hash")).alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(near_links(prints.select("fp"), radius))
    placed = cut(prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    keeps = cut(placed.groupBy("root").agg(F.min(F.struct("least.none", "least.id", "fp", "least.hash")).alias("keep"), F.count(F.lit(1)).alias("size")))
    classes = join_groups(placed, keeps, "root", "size", placed.count(), F.col("fp"))
    classes = cut(classes.select("fp", "n", F.col("keep.id").alias("component_id"), "keep"))
    return join_groups(rows, classes, "fp", "n", rows.count(), F.col(id_col)).select(id_col, "fp", "hash", "component_id", "keep")


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row: id, fingerprint (16 hex digits), component_id, fp.

    component_id is the least id reachable over links of ``radius`` (2 or 4) or fewer differing bits, the
    document itself included. Repeated rows each come back; an empty table gives no rows. Texts without words, null ones too, have fingerprint zero and link like
    any other. Null ids take part but never are a component's id unless it has no other.
    """
    out = placed_rows(docs, id_col, text_col, radius)
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows, all columns, of one document of each component: that with the least id, then the least
    fingerprint and text hash, which alone decide where no row has an id.

    The others leave by an anti join on id and text hash (which settles the fingerprint), so that texts
    that share an id, or have none, are judged each for itself. Rows equal in id and text are one document.
    """
    found = placed_rows(docs, id_col, text_col, radius)
    stays = F.col(id_col).eqNullSafe(F.col("keep.id")) & (F.col("fp") == F.col("keep.fp")) & (F.col("hash") == F.col("keep.hash"))
    drops = found.where(~stays).select(id_key(id_col).alias("_idk"), F.col("hash").alias("_hash")).distinct()
    base, names = set_apart(docs)
    keyed = base.withColumns({"_idk": id_key(names[id_col]), "_hash": F.xxhash64(F.coalesce(F.col(names[text_col]), F.lit("")))})
    return given_back(keyed.join(sized(drops)[0], ["_idk", "_hash"], "left_anti"), names)
