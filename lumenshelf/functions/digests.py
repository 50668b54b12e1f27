"""SHA-256 of large files, a part of each in a task: a digest is put down after one part and taken up at the next."""

from __future__ import annotations

import _hashlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.storage import removed, settled
from lumenshelf.functions.workers import map_arrow

#: Bytes of a file that one task takes into its digest.
ROUND_BYTES = 128 << 20
MARK = b"\xef\xbb\xbf"
#: Names that the text reader would unpack.
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|zstd|passthrough)$"


class Digest:
    """The SHA-256 of hashlib's own library, which unlike hashlib tells what it has taken in so far (state)."""

    lib = ctypes.CDLL(_hashlib.__file__)

    def __init__(self, state: bytes | None = None):
        self.at = ctypes.create_string_buffer(state or b"", 128)
        if state is None:
            self.lib.SHA256_Init(self.at)

    def update(self, data: pa.Buffer) -> None:
        self.lib.SHA256_Update(self.at, ctypes.c_void_p(data.address), ctypes.c_size_t(data.size))

    def state(self) -> bytes:
        return self.at.raw

    def hex(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, self.at)
        return out.raw.hex()


def resumable() -> bool:
    """Whether Python's libcrypto offers what Digest calls."""
    return all(hasattr(Digest.lib, f"SHA256_{n}") for n in ("Init", "Update", "Final"))


def line_parts(lines: DataFrame, round_bytes: int) -> DataFrame:
    """Lines (key, start, value) put together again: key, round, start, seq, n and data. Lines come in order within
    a split of a file. All but the first part of a file begin with the line end ahead of them."""

    def run(batches):
        last, seq = None, 0
        for batch in batches:
            key, start, value = batch.columns
            if not batch.num_rows:
                continue
            other = pc.or_(pc.not_equal(key[1:], key[:-1]), pc.not_equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
            cuts = np.array([0, *(np.flatnonzero(other) + 1), batch.num_rows], np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), value), pa.scalar(b"\n", value.type))
            for at, data in zip(cuts.tolist(), joined):
                here = (key[at].as_py(), start[at].as_py())
                seq, last = seq + 1 if here == last else 0, here
                whole = data.as_py() if here[1] == seq == 0 else b"\n" + data.as_py()
                row = {"key": [here[0]], "round": [here[1] // round_bytes], "start": [here[1]], "seq": [seq], "n": [len(whole)], "data": [whole]}
                yield pa.RecordBatch.from_pydict(row, pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("round", "start", "seq", "n")], ("data", pa.binary())]))

    return map_arrow(lines, run, "key string, round long, start long, seq long, n long, data binary")


def begun(batches):
    """States of files (key, missing) of which nothing but a byte order mark is in yet."""
    for batch in batches:
        states = []
        for key, missing in zip(*[c.to_pylist() for c in batch.columns]):
            if missing not in (0, 1, len(MARK), len(MARK) + 1):
                raise ValueError(f"{key} changed while it was read")
            one = Digest()
            one.update(pa.py_buffer(MARK if missing >= len(MARK) else b""))
            states.append(one.state())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, pa.binary())], ["key", "data"])


def carried(batches):
    """States (key, data) after the parts that follow each state, key by key."""
    key, one = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([key]), pa.array([one.state()], pa.binary())], ["key", "data"])
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != key:
                if one is not None:
                    yield out()
                key, one = k, Digest(data.as_py())
            else:
                one.update(data.as_buffer())
    if one is not None:
        yield out()


def ended(batches):
    """Digests (key, sha) of states (key, missing, data), with the last line end of files that have one."""
    for batch in batches:
        shas = []
        for missing, state in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            one = Digest(state)
            one.update(pa.py_buffer(b"\n" if missing % len(MARK) else b""))
            shas.append(one.hex())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas)], ["key", "sha"])


def digests(lines: DataFrame, files: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """SHA-256 (key, sha) of files (key, size) from their lines (key, start, value): the text reader's with ``\\n`` for
    line ends, start being that of the split a line comes from.

    The digest runs through a file in order, so there is a round for each ``round_bytes`` of the longest file: it takes
    the parts of that stretch of every file, a task a file, from the state that the round before wrote. The reader
    leaves out a byte order mark and does not tell a line end at the end; both show in the bytes missing.
    """
    spark = lines.sparkSession
    parts = settled(line_parts(lines, round_bytes))
    got = parts.groupBy("key").agg(F.sum("n").alias("got"))
    told = settled(files.join(got, "key", "left").select("key", (F.col("size") - F.coalesce("got", F.lit(0))).alias("missing")))
    n, rounds = told.count(), parts.agg(F.coalesce(F.max("round") + 1, F.lit(0))).first()[0]
    states, waste = settled(map_arrow(told, begun, "key string, data binary")), []
    for k in range(rounds):
        waste.append(states)
        rows = states.select("key", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("seq"), "data").unionByName(parts.where(F.col("round") == k).select("key", "start", "seq", "data"))
        # More places than files, so that few files share a task.
        dealt = rows.repartition(4 * n, "key").sortWithinPartitions("key", "start", "seq")
        states = settled(map_arrow(dealt.select("key", "data"), carried, "key string, data binary"))
    found = settled(map_arrow(told.join(states, "key").select("key", "missing", "data"), ended, "key string, sha string"))
    removed(spark, *{f.rpartition("/")[0] for rows in (parts, told, states, *waste) for f in rows.inputFiles()})
    return found
