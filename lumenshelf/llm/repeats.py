"""Repeated byte strings across documents: run-length Burrows-Wheeler indexes over shared passages.

An index of the whole corpus fits no task, so the corpus is dealt to many small ones such that equal
strings always meet. Every window of LENGTH bytes is named by the least hash among the KEY-byte strings
in it, which depends on the window alone. Neighbouring windows that share the place of that string form
a passage; windows with a name that occurs once cannot repeat. Passages equal as a whole are settled by counting, the
others go to an index by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.workers import group_arrow, map_arrow
from lumenshelf.llm.common import cut, map_rows, text_or_empty

LENGTH = 200
#: Bytes of the strings whose hashes name windows, level by level. A name with more than
#: NAME_PASSAGES distinct passages is split by the next level; the last one is the window itself.
KEYS = (32, 64, 128, 200)
NAME_PASSAGES = 4096
#: Bytes of passages in one index, and windows of a text that are named at a time.
INDEX_BYTES, BLOCK = 1 << 20, 1 << 20
#: Bytes of passages that a task indexes, one index after the other.
TASK_BYTES = 16 << 20
#: Between the passages of an index stands a byte that UTF-8 does not use.
BORDER = b"\xff"

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
NO_ID = -(1 << 63)


def words8(data: bytes) -> np.ndarray:
    """The eight bytes from each position on, as a number whose order is that of the bytes; zero beyond the end."""
    out = np.empty(len(data) + 8 & ~7, np.uint64)
    filled = data + bytes(16)
    for k in range(8):
        out[k::8] = np.frombuffer(filled, ">u8", len(out) // 8, k)
    return out[: len(data)]


def key_hashes(data: bytes, size: int) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes (8 or more) at each position that holds one."""
    hashes, width = words8(data)[: max(0, len(data) - 7)], 8
    while width < size:
        step = min(width, size - width)
        hashes = hashes[:-step] * _M1 ^ hashes[step:] * _M2
        hashes ^= hashes >> np.uint64(29)
        width += step
    return hashes * _M3


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbouring values."""
    width = 1
    while width < size:
        step = min(width, size - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


def named_passages(data: bytes, size: int, length: int = LENGTH, block_bytes: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one name: first window, number of windows, name."""
    starts, counts, names = [], [], []
    for at in range(0, len(data) - length + 1, block_bytes):
        block = data[at : at + block_bytes + length - 1]
        hashes = key_hashes(block, size)
        least = sliding_least(hashes, length - size + 1)
        # The leftmost place of the least hash moves where a lesser one enters or it leaves the window.
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (hashes[: len(least) - 1] == least[:-1])]))
        starts.append(first + at)
        counts.append(np.diff(np.append(first, len(least))))
        names.append(least[first])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(names).view(np.int64)


def content_hashes(data: bytes, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(data[a:b]) for a, b in zip(starts.tolist(), (starts + counts + length - 1).tolist())], np.uint64).view(np.int64)


PASSAGE = "id long, tk long, start int, n int, name long, content long"


def passages(rows: DataFrame, length: int, size: int, block_bytes: int = BLOCK) -> DataFrame:
    """All named passages of rows (id, tk, text): where they start, windows, name and content hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (c for c in batch.columns)
            for low in range(0, batch.num_rows, 500):
                parts: list[list[np.ndarray]] = [[] for _ in range(4)]
                of = []
                for row in range(low, min(low + 500, batch.num_rows)):
                    data = texts[row].as_py().encode()
                    starts, counts, names = named_passages(data, size, length, block_bytes)
                    for part, values in zip(parts, (starts, counts, names, content_hashes(data, starts, counts, length))):
                        part.append(values)
                    of.append(np.full(len(starts), row))
                at = pa.array(np.concatenate(of))
                start, n, name, content = (np.concatenate(p) for p in parts)
                yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(name), pa.array(content)], ["id", "tk", "start", "n", "name", "content"])

    return map_arrow(rows.select("id", "tk", "text"), run, PASSAGE)


class RunIndex:
    """A run-compressed Burrows-Wheeler transform with sampled run ends.

    Suffixes are sorted to a depth beyond any passage by doubling ranks. Of the transform only runs are
    kept, and of the suffix array the entries at run heads and tails, each with the length it shares
    with the suffix across that border. Inside a run these lengths follow from the one before: they are
    one less at the next position of the text.
    """

    def __init__(self, text: bytes, depth: int):
        n = len(text)
        self.n = n
        words = words8(text)
        order = np.argsort(words)
        ranks, width = [self.rank(words[order], order)], 8
        # Ranks are all different once they add up to the sum of all places.
        while width < depth and int(ranks[-1].sum(dtype=np.int64)) != n * (n - 1) // 2:
            last = ranks[-1].astype(np.int64)
            beyond = np.zeros(n, np.int64)
            beyond[: n - width if n > width else 0] = last[width:] + 1
            both = last * (n + 1) + beyond
            order = np.argsort(both)
            ranks.append(self.rank(both[order], order))
            width *= 2
        self.ranks = ranks
        octets = np.frombuffer(text, np.uint8)
        transform = octets[order - 1]  # before the first position stands the last
        change = transform[1:] != transform[:-1]
        border = np.flatnonzero(change)
        # The suffixes on both sides of each run border, and what they share.
        self.tails, self.heads = order[border], order[border + 1]
        self.runs = len(border) + 1
        self.shared = self.common(self.tails, self.heads, octets)
        self.order, self.octets = order, octets

    @staticmethod
    def rank(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Rank of each position: equal keys share one, the number of the last of them."""
        out = np.empty(len(order), np.int32)
        last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
        out[order] = np.repeat(last, np.diff(last, prepend=-1))
        return out

    def common(self, a: np.ndarray, b: np.ndarray, octets: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b: equal ranks at falling widths, then bytes."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in [len(self.ranks) - 1, *range(len(self.ranks) - 1, -1, -1)]:
            inside = (a < self.n) & (b < self.n)
            same = inside & (self.ranks[level][np.minimum(a, self.n - 1)] == self.ranks[level][np.minimum(b, self.n - 1)])
            step = same * (8 << level)
            a, b, total = a + step, b + step, total + step
        same = np.ones(len(a), bool)
        for _ in range(7):  # the bytes of the last, partial word
            same &= (a < self.n) & (b < self.n)
            same &= octets[np.minimum(a, self.n - 1)] == octets[np.minimum(b, self.n - 1)]
            a, b, total = a + same, b + same, total + same
        return total

    def matching_statistics(self, firsts: np.ndarray) -> np.ndarray:
        """For each position the length of its longest match that starts elsewhere.

        Streams over the text: a sampled position has its stored length, every other one less than the
        position before. ``firsts``, where passages start, are sampled too.
        """
        reach = np.zeros(self.n, np.int64)
        np.maximum.at(reach, self.heads, self.shared + self.heads)
        np.maximum.at(reach, self.tails, self.shared + self.tails)
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        for step in (-1, 1):
            beside = place[firsts] + step
            real = (beside >= 0) & (beside < self.n)
            here = firsts[real]
            np.maximum.at(reach, here, self.common(here, self.order[beside[real]], self.octets) + here)
        return np.maximum.accumulate(reach) - np.arange(self.n)


def repeated_windows(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """Runs of windows (text, first window, after the last) that occur twice among the texts."""
    joined = BORDER.join(texts) + BORDER
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    index = RunIndex(joined, 1 << int(max(length, sizes.max())).bit_length())
    long = index.matching_statistics(firsts) >= length
    inside = np.zeros(len(joined) + 1, np.int8)
    np.add.at(inside, firsts, 1)
    np.add.at(inside, firsts + np.maximum(0, sizes - length + 1), -1)
    long &= np.cumsum(inside[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], long.astype(np.int8), [0]])))
    heads, ends = edges[::2], edges[1::2]
    of = np.searchsorted(firsts, heads, side="right") - 1
    yield from zip(of.tolist(), (heads - firsts[of]).tolist(), (ends - firsts[of]).tolist())


def indexed_spans(rows: DataFrame, length: int) -> DataFrame:
    """Repeated byte spans (id, tk, a, b) of rows (name, id, tk, start, solo, bytes), all passages of a
    name in one index.

    Names are dealt by hash to as many indexes as keep INDEX_BYTES to each, and an index is a group: so
    every plan, also one that adaptive execution changes on the way, must bring it together whole.
    """
    rows = rows.select("name", "id", "tk", "start", "solo", "bytes")
    size = rows.agg(F.sum(F.octet_length("bytes").cast("long"))).first()[0] or 0
    indexes = max(1, -(-size // INDEX_BYTES))

    def run(held: pa.Table) -> pa.Table:
        docs, keys, starts, solos, texts = (held.column(k).to_pylist() for k in ("id", "tk", "start", "solo", "bytes"))
        found = [(docs[k], keys[k], starts[k] + first, starts[k] + after - 1 + length) for k, first, after in repeated_windows(texts, length) if solos[k]]
        columns = list(zip(*found)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "tk", "a", "b"])

    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    dealt = rows.withColumn("index", F.pmod(F.xxhash64("name"), F.lit(indexes))).drop("name").repartition(tasks, "index")
    return group_arrow(dealt, ["index"], run, "id long, tk long, a int, b int")


def cut_out(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted passages (id, tk, name, start, n, solo), read from their texts."""
    lists = wanted.groupBy("id", "tk").agg(F.collect_list(F.struct("name", "start", "n", "solo")).alias("w"))
    joined = rows.join(lists, ["id", "tk"])

    def run(batches):
        for batch in batches:
            out = []
            for doc, tk, text, w in zip(*[c.to_pylist() for c in batch.columns]):
                data = text.encode()
                out += [(p["name"], doc, tk, p["start"], p["n"], p["solo"], data[p["start"] : p["start"] + p["n"] + length - 1]) for p in w]
            columns = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["name", "id", "tk", "start", "n", "solo", "bytes"])

    return map_arrow(joined.select("id", "tk", "text", "w"), run, "name long, id long, tk long, start int, n int, solo boolean, bytes binary")


def renamed(rows: DataFrame, length: int, size: int) -> DataFrame:
    """Passages with bytes, each split into those of the next level of names."""

    def run(batches):
        for batch in batches:
            out = []
            for name, doc, tk, start, solo, data in zip(*[c.to_pylist() for c in batch.columns]):
                starts, counts, names = named_passages(data, size, length)
                for a, n, new in zip(starts.tolist(), counts.tolist(), names.tolist()):
                    part = data[a : a + n + length - 1]
                    mixed = xxhash.xxh3_64_intdigest(new.to_bytes(8, "little", signed=True), name & ((1 << 64) - 1)) >> 1
                    out.append((mixed, doc, tk, start + a, n, solo, part, xxhash.xxh3_64_intdigest(part) >> 1))
            columns = list(zip(*out)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["name", "id", "tk", "start", "n", "solo", "bytes", "content"])

    return map_arrow(rows.select("name", "id", "tk", "start", "solo", "bytes"), run, "name long, id long, tk long, start int, n int, solo boolean, bytes binary, content long")


def whole(rows: DataFrame, length: int) -> DataFrame:
    """The bytes that all windows of a passage cover."""
    return rows.select("id", "tk", F.col("start").alias("a"), (F.col("start") + F.col("n") + (length - 1)).cast("int").alias("b"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, name_passages: int = NAME_PASSAGES, keys: tuple[int, ...] = KEYS, block_bytes: int = BLOCK) -> DataFrame:
    """Byte spans (id, tk, a, b), which may overlap, that cover exactly the bytes of rows (id, tk, text)
    inside a string of ``length`` bytes that also starts elsewhere."""
    found = passages(rows, length, keys[0], block_bytes)
    names = found.groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.min("content").alias("c0"), F.max("content").alias("c1")).where("times > 1")
    # Cut, the names are shuffled by themselves, and adaptive execution can split a name with many passages.
    names = cut(names.select("name", (F.col("c0") == F.col("c1")).alias("uniform")))
    shared = cut(found.join(names, "name"))
    spans = [whole(shared.where("uniform"), length)]

    mixed = shared.where("NOT uniform")
    contents = cut(mixed.groupBy("name", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "tk", "start", "n")).alias("p")))
    spans.append(whole(mixed.join(contents.where("times > 1").select("name", "content"), ["name", "content"], "left_semi"), length))
    # Names whose passages all occur twice are settled.
    sizes = cut(contents.groupBy("name").agg(F.count(F.lit(1)).alias("passages"), F.max((F.col("times") == 1).cast("int")).alias("open")).where("open = 1"))
    wanted = contents.join(sizes, "name").select("name", "p.*", (F.col("times") == 1).alias("solo"), "passages")
    crowded_names = cut(sizes.where(F.col("passages") > name_passages).select("name"))
    held = cut(cut_out(rows, wanted, length))
    if crowded_names.isEmpty():
        spans.append(indexed_spans(held, length))
    else:
        spans.append(indexed_spans(held.join(crowded_names, "name", "left_anti"), length))
        spans += split_crowded(held.join(crowded_names, "name", "left_semi"), length, name_passages, keys[1:])
    return union(spans)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def split_crowded(rows: DataFrame, length: int, name_passages: int, keys: tuple[int, ...]) -> list[DataFrame]:
    """Names with too many passages for one index, named again by longer strings until they fit. The
    last level names each window by itself, where counting settles all."""
    spans = []
    for level, size in enumerate(keys):
        rows = cut(renamed(rows, length, size))
        # A passage that stands for several (not solo) counts as two.
        times = F.sum(F.when(F.col("solo"), F.lit(1)).otherwise(F.lit(2)))
        contents = cut(rows.groupBy("name", "content").agg(times.alias("times"), F.min(F.struct("id", "tk", "start", "n")).alias("p")))
        repeated = contents.where("times > 1").select("name", "content")
        spans.append(whole(rows.where("solo").join(repeated, ["name", "content"], "left_semi"), length))
        if level == len(keys) - 1:
            return spans
        sizes = contents.groupBy("name").agg(F.count(F.lit(1)).alias("passages"), F.max((F.col("times") == 1).cast("int")).alias("open"))
        sizes = sizes.where("open = 1 AND passages > 1")
        first = contents.join(sizes, "name").select("name", F.col("p.id").alias("id"), F.col("p.tk").alias("tk"), F.col("p.start").alias("start"), F.col("p.n").alias("n"), (F.col("times") == 1).alias("solo"), "passages")
        kept = cut(rows.drop("solo", "content").join(first, ["name", "id", "tk", "start", "n"]))
        fitting = kept.where(F.col("passages") <= name_passages)
        spans.append(indexed_spans(fitting, length))
        rows = kept.where(F.col("passages") > name_passages).drop("passages")
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, name_passages: int = NAME_PASSAGES, block_bytes: int = BLOCK) -> DataFrame:
    """Each text without its repeated bytes: id, n_bytes, n_removed, n_spans, kept (binary).

    A byte goes if a string of ``length`` bytes over it also starts at another place, of the same
    document or of any other; copies of a document thus go whole. Strings are judged on the input.
    Null texts count as empty. Rows that repeat id and text are copies of each other.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("tk", F.xxhash64("text")).select("id", "tk", "text")
    spans = repeated_spans(rows.where(F.octet_length("text") >= length), length, name_passages, block_bytes=block_bytes)
    lists = spans.groupBy("id", "tk").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = rows.join(lists, ["id", "tk"], "left")

    def start():
        def one(doc, text, found):
            data = text.encode()
            merged: list[list[int]] = []
            for a, b in sorted((s["a"], s["b"]) for s in found or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            kept, at = [], 0
            for a, b in merged:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            left = b"".join(kept)
            return doc if doc != NO_ID else None, len(data), len(data) - len(left), len(merged), left

        return one

    return map_rows(joined, start, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept binary", ["id", "text", "spans"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """remove_repeats with the hash of what is kept in place of the bytes."""
    return remove_repeats(docs, id_col, text_col).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
