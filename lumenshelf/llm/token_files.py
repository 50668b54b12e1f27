"""Files of token ids in Simple-8b words: 64-bit words whose selectors pack varying counts of ids."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenshelf.functions.storage import shared_folder
from lumenshelf.functions.workers import map_arrow
from lumenshelf.llm.bpe import byte_characters
from lumenshelf.llm.common import cut, text_or_empty

#: Fixed values of the coding: ids per word and bits per id of each selector (4 bits) over 60 bits of ids.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Ids of a block, the unit of reading, and ids after which a file is closed.
BLOCK_IDS, FILE_IDS = 4096, 1 << 20
#: Ids that are packed at once.
PACK_IDS = 1 << 20
MAGIC = b"S8TK"
HEADER = "<4sIQQQQQ"
#: Encodings of words that a task keeps, and as many older ones.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Characters of the texts that are split at once, the last of them whole.
RUN_CHARS = 1 << 23


# --- coding -------------------------------------------------------------------------------------------


def pack(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids as words, escaped ids, and per block the number of the first word and of the first escape.

    A slot of all ones is an escape: the id is too wide for it and stands in the list of escapes. At every
    place the selector wins that needs the fewest 64-bit numbers an id, escapes counted as one each, so an
    outlier among small ids does not cost the others their width. Blocks do not share words.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    step = max(PACK_IDS // block, 1) * block
    parts = [pack_blocks(ids[at : at + step], block) for at in range(0, len(ids), step)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, escapes, word_at, escape_at = zip(*parts)
    shifted = lambda places, of: np.concatenate([p + s for p, s in zip(places, np.cumsum([0, *map(len, of)]))])
    return np.concatenate(words), np.concatenate(escapes), shifted(word_at, words), shifted(escape_at, escapes)


def gains(escapes: np.ndarray, count: int, end: int, sure: int) -> bool:
    """Whether a word of ``count`` slots takes more than ``sure`` ids a number at any place of rows that have ``end`` ids."""
    whole = max(end - count + 1, 0)
    rest = end - np.arange(whole, end) > sure * (escapes[:, whole:end] + 1)
    return bool(rest.any()) or (whole > 0 and len(escapes) > 0 and count > sure * (int(escapes[:, :whole].min()) + 1))


def too_wide(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The selectors worth a look, widest first, and for each and each row of ids how many ahead of a place are too wide for it.

    The widest of them takes every id, so one that nowhere takes more ids a number is left out. The last row has ``end`` ids,
    and zeros stand behind each row.
    """
    block, top, longest = ids.shape[1], int(ids.max()), int(COUNTS[0])
    limits = np.maximum((1 << WIDTHS) - 1, 1)
    last = int(np.searchsorted(limits, top, "right")) if top < limits[-1] else 15
    sure = int(COUNTS[last]) if top < limits[last] else 0
    kept, sums = [], []
    for s in range(last, -1, -1):
        ahead = np.zeros((len(ids), block + longest + 1), np.uint16)
        if limits[s] <= top:
            np.cumsum(ids >= ids.dtype.type(limits[s]), axis=1, dtype=np.uint16, out=ahead[:, 1 : block + 1])
            ahead[:, block + 1 :] = ahead[:, block : block + 1]
        count = int(COUNTS[s])
        escapes = ahead[:, count : block + count] - ahead[:, :block]
        if s == last or gains(escapes[:-1], count, block, sure) or gains(escapes[-1:], count, end, sure):
            kept.append(s)
            sums.append(ahead)
    return np.array(kept), np.stack(sums)


def pack_blocks(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pack for some blocks, which step from word to word side by side. Of equal selectors the widest wins."""
    n, rows = len(ids), -(-len(ids) // block)
    grid = np.zeros(rows * block, np.uint32 if int(ids.max()) < 1 << 32 else np.uint64)
    grid[:n] = ids
    ends = np.minimum(n - np.arange(rows) * block, block)
    selectors, sums = too_wide(grid.reshape(rows, block), int(ends[-1]))
    counts = COUNTS[selectors]
    no_bits = WIDTHS[selectors] == 0
    here = np.arange(len(selectors) * rows).reshape(-1, rows) * sums.shape[2]
    there, sums, slots = here + counts[:, None], sums.ravel(), counts[:, None].astype(np.float32)
    at, steps = np.zeros(rows, np.int64), []
    while (at < ends).any():
        escapes, left = sums.take(there + at) - sums.take(here + at), ends - at
        worth = np.minimum(slots, left.astype(np.float32)) / (escapes + np.float32(1))
        if no_bits.any():
            worth[no_bits[:, None] & (escapes > 0)] = 0  # a slot of no bits has no room for the mark
        pick = worth.argmax(axis=0)
        took = np.minimum(counts.take(pick), left)
        steps.append((pick, at, took))
        at = at + took
    pick, at, took = (np.stack(part, axis=1) for part in zip(*steps))
    inside = took > 0
    chosen, took, first = selectors[pick[inside]], took[inside], (at + np.arange(rows)[:, None] * block)[inside]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(int(COUNTS[0]), np.uint64)])
    escaped = [np.zeros(0, np.int64)]
    for s in np.unique(chosen).tolist():
        if WIDTHS[s]:
            of = np.flatnonzero(chosen == s)
            count, width, at = int(COUNTS[s]), int(WIDTHS[s]), first[of]
            values = sliding_window_view(padded, count)[at]
            short = took[of] < count
            if short.any():
                values[np.arange(count) >= took[of][:, None]] = 0
            over = values >= np.uint64((1 << width) - 1)
            if over.any():
                row, slot = np.nonzero(over)
                escaped.append(at[row] + slot)
                values[over] = (1 << width) - 1
            # Slots do not overlap, so the word is the sum of its shifted values.
            words[of] |= values @ (np.uint64(1) << (np.arange(count) * width).astype(np.uint64))
    wide_at = np.sort(np.concatenate(escaped))
    firsts = np.arange(0, n, block)
    return words, ids[wide_at], np.searchsorted(first, firsts), np.searchsorted(wide_at, firsts)


def unpack(words: np.ndarray, escapes: np.ndarray, word_at: np.ndarray, n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The n ids of whole blocks of words and escapes, all words of a selector at once. word_at has the
    number of each block's first word; the counts of a block's words add up from there."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    ahead = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(word_at)), np.diff(np.append(word_at, len(words))))
    starts = ahead - ahead[word_at][of] + of * block
    ends = np.minimum((of + 1) * block, n)
    out, marked = np.zeros(n, np.uint64), np.zeros(n, bool)
    short = starts + counts > ends
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            width, mark = int(WIDTHS[s]), np.uint64((1 << int(WIDTHS[s])) - 1)
            slots = np.arange(COUNTS[s])
            values = (words[rows][:, None] >> (slots * width).astype(np.uint64)) & mark
            where = starts[rows][:, None] + slots
            if short[rows].any():
                inside = where < ends[rows][:, None]
                values, where = values[inside], where[inside]
            out[where] = values
            marked[where[values == mark]] = True
    out[marked] = escapes
    return out


class TokenFile:
    """One file: a header, the documents' ids, ends and null marks, then blocks, words and escapes.

    Documents are looked up by place; only the blocks that hold them are decoded.
    """

    def __init__(self, data: bytes | memoryview):
        magic, self.block, docs, self.n, words, escapes, self.first = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        blocks = -(-self.n // self.block)
        at = struct.calcsize(HEADER)

        def take(count: int, kind: type) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.ids, self.ends, self.nulls = take(docs, np.int64), take(docs, np.int64), take(docs, np.uint8)
        at += -at % 8
        self.word_at, self.escape_at = take(blocks, np.int64), take(blocks, np.int64)
        self.words, self.escapes = take(words, np.uint64), take(escapes, np.uint64)

    @staticmethod
    def build(keys: list[int | None], tokens: list[np.ndarray], first: int) -> bytes:
        """The bytes of a file; first counts the ids of the partition's files before it."""
        ids = np.concatenate(tokens)
        words, escapes, word_at, escape_at = pack(ids)
        head = struct.pack(HEADER, MAGIC, BLOCK_IDS, len(keys), len(ids), len(words), len(escapes), first)
        parts = [np.array([k or 0 for k in keys], np.int64), np.cumsum([len(t) for t in tokens], dtype=np.int64), np.array([k is None for k in keys], np.uint8)]
        front = head + b"".join(p.tobytes() for p in parts)
        return front + bytes(-len(front) % 8) + b"".join(p.tobytes() for p in (word_at.astype(np.int64), escape_at.astype(np.int64), words, escapes))

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop of the file."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        a, b = start // self.block, -(-stop // self.block)
        words = self.words[self.word_at[a] : self.word_at[b] if b < len(self.word_at) else None]
        escapes = self.escapes[self.escape_at[a] : self.escape_at[b] if b < len(self.escape_at) else None]
        got = unpack(words, escapes, self.word_at[a:b] - self.word_at[a], min(b * self.block, self.n) - a * self.block, self.block)
        return got[start - a * self.block : stop - a * self.block]

    def documents(self, ids_at_once: int = 1 << 18) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids before it in the partition, token ids) of each document, decoded a run of blocks at a time."""
        start, held, held_from = 0, np.zeros(0, np.uint64), 0
        for key, end, null in zip(self.ids.tolist(), self.ends.tolist(), self.nulls.tolist()):
            if end > held_from + len(held):
                held_from, held = start, self.read(start, min(max(start + ids_at_once, end), self.n))
            yield None if null else key, self.first + start, held[start - held_from : end - held_from]
            start = end


# --- tokenising ---------------------------------------------------------------------------------------


#: Latin letters up to another character of ASCII or the end.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ -@\[-`{-~]|\Z)")
#: A space that belongs to white space after it or ends the text, and the other spaces.
LOOSE, AHEAD = re.compile(r" (?!\S)"), re.compile(r" (?=\S)")
#: Up to the last line feed that stands alone with more of the piece after it.
LINE = re.compile(r"(?s:.*\S)?\n(?=\S)")


class Pieces(dict):
    """Ids of pieces of text, as little-endian 32-bit numbers, asked of the tokenizers library once each while they are kept.

    Each piece stands after ``space``, which its key leaves out. Latin letters are one piece for the library too, so its model
    merges them at once. What follows them or a line feed is looked up as a piece after no space.
    """

    def __init__(self, library, space: str, bare: Pieces | None = None):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.merge, self.whole = library.model.tokenize, library.encode
        # Byte-level vocabularies write each byte as a character.
        spell = dict(enumerate(byte_characters()))
        self.spelling = {c: "".join(spell[b] for b in chr(c).encode()) for c in range(0x100)}
        self.space, self.spelled = space, space.translate(self.spelling)
        self.bare = self if bare is None else bare

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            start = LETTERS.match(piece) or (LINE.match(piece) if len(piece) <= CACHE_CHARS else None)
            if start is None:
                found = array("I", self.whole(self.space + piece, add_special_tokens=False).ids).tobytes()
            elif (end := start.end()) < len(piece):
                return self[piece[:end]] + self.bare[piece[end:]]
            else:
                spelled = piece if piece.isascii() else piece.translate(self.spelling)
                found = array("I", [t.id for t in self.merge(self.spelled + spelled)]).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """The tokenizers library over byte-level vocabularies, asked once for each piece.

    Such a vocabulary's pattern starts a piece at every space that a character other than white space
    follows, whatever stands before, and ends one where Latin letters end or behind a line feed without other
    white space about it; its special tokens hold no space and begin with neither. A text is therefore cut there, and the ids of its
    pieces are those of the whole text. Vocabularies of another kind are asked for whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        plain = all(not t["lstrip"] and not t["rstrip"] and not re.search(r"\s|^\w", t["content"]) for t in spec["added_tokens"])
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec["normalizer"] is None and plain
        self.whole = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.first = Pieces(library, "")
        self.after = Pieces(library, " ", self.first)

    def encode(self, text: str) -> bytes:
        """The ids of one text, as little-endian 32-bit numbers."""
        if not self.by_piece:
            return self.whole(text)
        first, *rest = AHEAD.split(text)
        return self.first[first] + b"".join(map(self.after.__getitem__, rest))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, for a run of RUN_CHARS of them at a time: Arrow splits a run and numbers its
        distinct words, so that only these are looked up."""
        run, held = [], 0
        for text in texts:
            run.append(text.as_py())
            held += len(run[-1])
            if held >= RUN_CHARS:
                yield from self.encode_run(run)
                run, held = [], 0
        if run:
            yield from self.encode_run(run)

    def encode_run(self, texts: list[str]) -> Iterator[np.ndarray]:
        # A text with white space behind a space is encoded by itself and stands for its first word.
        alone = {k: self.encode(text) for k, text in enumerate(texts) if not self.by_piece or LOOSE.search(text)}
        split = pc.split_pattern(pa.array(["" if k in alone else text for k, text in enumerate(texts)], pa.string()), " ")
        coded, starts = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        pieces = [*map(self.after.__getitem__, words)]
        pieces += [alone[k] if k in alone else self.first[words[index[at]]] for k, at in enumerate(starts[:-1].tolist())]
        index[starts[:-1]] = np.arange(len(words), len(pieces))
        ids, sizes = np.frombuffer(b"".join(pieces), "<u4"), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        places, counts = np.cumsum(sizes) - sizes, sizes[index]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat((places[index] - ends[:-1]).astype(np.int32), counts)
        at += np.arange(len(at), dtype=np.int32)
        found = ids[at]
        for a, b in zip(ends[starts[:-1]].tolist(), ends[starts[1:]].tolist()):
            yield found[a:b]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The tokenizer, read once per Python worker."""
    return Encoder(path)


# --- files --------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> None:
    """Encode every whole text, append end_id and write the ids in ascending order of id under folder/tokens.

    Rows are ranged by id (null last), equal ids by a hash of the text and the text itself, and encoded after the shuffle, once.
    A task closes a file after ``file_ids`` ids, so no more than that and one document is held. Each file
    is one record that Spark's text writer puts out as it is, followed by a line feed. Null counts as the empty text; an empty table gives no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, last = encoder(tokenizer).encode_all, np.array([end_id], "<u4")
        part = TaskContext.get().partitionId()
        keys, tokens, n, before = [], [], 0, 0

        def file() -> pa.RecordBatch:
            data = part.to_bytes(8, "little") + TokenFile.build(keys, tokens, before)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1)), strict=True):
                tokens.append(np.concatenate([ids, last]))
                keys.append(key)
                n += len(tokens[-1])
                if n >= file_ids:
                    yield file()
                    keys, tokens, n, before = [], [], 0, before + n
        if keys:
            yield file()

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_last(), F.col("hash"), F.col("text")]
    ranged = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("id", "text")
    # The writer puts out the bytes of a string unchanged, and the cast keeps them.
    files = map_arrow(ranged, run, "data binary").select(F.col("data").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(f"{folder}/tokens")


def read_token_files(spark: SparkSession, folder: str, each, schema: str) -> DataFrame:
    """each(id, start, ids) of all documents in the files under the folder. A column named start is to return the start that
    ``each`` was given, and then counts the ids of all documents before it.

    Files tell the ids before a document in its partition; the driver adds up one number per written partition.
    What ``each`` returns is cut, so that files are read once.
    """
    from pyspark.sql.types import _parse_datatype_string

    files = spark.read.format("binaryFile").load(f"{folder}/tokens").where("length > 0")
    told = f"{schema}, _part long, _before long, _n long"
    kinds = _parse_datatype_string(told)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())
                part = int.from_bytes(data[:8], "little")
                rows = [(*each(key, start, ids), part, start, len(ids)) for key, start, ids in TokenFile(data[8:]).documents()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    found = cut(map_arrow(files.select("content"), run, told))
    bases, total = [], 0
    for part, n in sorted(tuple(r) for r in found.groupBy("_part").agg(F.max(F.col("_before") + F.col("_n"))).collect()):
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "_part long, _base long")
    names = kinds.fieldNames()[:-3]
    return found.join(F.broadcast(base), "_part").select(*[(F.col("_base") + F.col(c)).alias(c) if c == "start" else F.col(c) for c in names])


def digests(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files, read them back: id, start, n_tokens (with the end id), ids_crc32.

    One row per row, repeats included; rows equal in id and text stand next to each other.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer, folder, 0, id_col, text_col)
    return read_token_files(spark, folder, lambda key, start, ids: (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), f"{id_col} long, start long, n_tokens long, ids_crc32 long")
