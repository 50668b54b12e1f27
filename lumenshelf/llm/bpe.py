"""Byte-pair encoding with a priority queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from hashlib import sha256
from itertools import count
from unicodedata import is_normalized, normalize

import regex
from pyspark.sql import DataFrame

from lumenshelf.llm.common import map_rows

#: Pieces whose encodings a task keeps, and as many older ones, of which those used again come back;
#: the others go, so memory stays bounded.
CACHE_PIECES = 120_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the rest take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = count(256)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A vocabulary file: token ids, merge ranks, splitting pattern and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Ranks by pair of ids (a * size + b), and the id that the merge of each rank makes.
        self.size = max(self.ids.values()) + 1
        self.ranks = {self.ids[a] * self.size + self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        #: Ids of each byte inside a piece and at its end.
        self.inner = [self.ids[c] for c in byte_characters()]
        self.last = [self.ids[c + end] for c in byte_characters()]
        self.cache: dict[str, tuple[list[int], str, str]] = {}
        self.older: dict[str, tuple[list[int], str, str]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge adjacent ids, lowest rank first and leftmost among equals, until none is left.

        Queue entries are rank * n + place. ``pair`` holds the rank of the pair that begins at a place
        now, so an entry with another rank is stale.
        """
        n, size = len(symbols), self.size
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        rank_of, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        pair = [rank_of(a * size + b, -1) for a, b in zip(symbols, symbols[1:])]
        pair.append(-1)
        queue = [rank * n + i for i, rank in enumerate(pair) if rank >= 0]
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(pop(queue), n)
            if pair[i] != rank:
                continue  # stale: a neighbour was merged since this entry was made
            j = right[i]
            k = right[i] = right[j]
            symbols[i] = merged = self.made[rank]
            symbols[j] = pair[j] = -1
            if k < n:
                left[k] = i
                pair[i] = rank = rank_of(merged * size + symbols[k], -1)
                if rank >= 0:
                    push(queue, rank * n + i)
            else:
                pair[i] = -1
            h = left[i]
            if h >= 0:
                pair[h] = rank = rank_of(symbols[h] * size + merged, -1)
                if rank >= 0:
                    push(queue, rank * n + h)
        return [s for s in symbols if s >= 0]

    def piece(self, text: str) -> tuple[list[int], str, str]:
        """Ids of one piece, the ids as decimals and the vocabulary strings, both joined by a space."""
        got = self.older.pop(text, None)
        if got is None:
            data = text.encode()
            symbols = [self.inner[b] for b in data]
            symbols[-1] = self.last[data[-1]]
            found = self.merge(symbols)
            got = (found, " ".join(map(str, found)), " ".join([self.strings[i] for i in found]))
        if len(self.cache) >= CACHE_PIECES:
            self.older = self.cache.copy()
            self.cache.clear()
        self.cache[text] = got
        return got

    def normalise(self, text: str) -> str:
        """NFC, and lower case taken character by character. The file also makes one space of each run of
        white space, but no piece holds or looks at white space."""
        if not text.isascii() and not is_normalized("NFC", text):
            text = normalize("NFC", text)
        # str.lower gives a final sigma its own form, which depends on the neighbours.
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def spans(self, text: str) -> list[tuple[list[int], str, str]]:
        """The encoded pieces of a text; special tokens in it keep their ids."""
        out = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(([self.special[part]], str(self.special[part]), part))
            elif part:
                get, piece = self.cache.get, self.piece
                out += [get(p) or piece(p) for p in self.pieces.findall(self.normalise(part))]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids, _, _ in self.spans(text) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings joined as the file's missing decoder does: by a space. Unknown ids vanish."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary, read once per Python worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each whole text: id, n_tokens, token_ids. Null texts count as empty: no tokens."""

    def start():
        words = vocabulary(path)

        def one(doc, text):
            ids = words.encode(text or "")
            return doc, len(ids), ids

        return one

    return map_rows(docs, start, f"{id_col} long, n_tokens long, token_ids array<int>", [id_col, text_col])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The text of each list of ids: id, decoded. A null list counts as empty."""

    def start():
        words = vocabulary(path)
        return lambda doc, ids: (doc, words.decode(ids or []))

    return map_rows(encoded, start, f"{id_col} long, decoded string", [id_col, ids_col])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text: id, n_tokens, ids_sha256, decoded_sha256.

    The same pieces as ``encode`` and the same strings as ``decode``, hashed where they are made so
    that ids need not leave the task. Null counts as empty; one row per row, repeats included.
    """

    def start():
        words = vocabulary(path)

        def one(doc, text):
            spans = words.spans(text or "")
            lists, ids, strings = zip(*spans) if spans else ((), (), ())
            return doc, sum(map(len, lists)), sha256(" ".join(ids).encode()).hexdigest(), sha256(" ".join(strings).encode()).hexdigest()

        return one

    return map_rows(docs, start, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string", [id_col, text_col])
