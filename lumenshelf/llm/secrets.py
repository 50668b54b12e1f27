"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from hashlib import sha256
from math import log2

from pyspark.sql import DataFrame

from lumenshelf.llm.common import map_rows

# The base kinds, in order, with their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "entropy")

#: Strings that may hold a secret for the entropy scan.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LEAST_RUN = 20
#: Per character class: pattern of a run within a candidate, window in characters, least bits per
#: character. Each class is judged on its own runs, so a label joined to a key does not widen its class.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 3.0),
    ("base32", re.compile(r"[A-Z2-7]{20,}=*"), 20, 3.5),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 24, 3.9),
)
#: Identifiers, dates, paths and plain words look random but are none: candidates and runs that are so as a whole.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
ALLOWED = tuple(re.compile(p) for p in (UUID, r"[0-9_=+/-]+", r"[A-Za-z]+", r"[A-Za-z]?[a-z]+([_/-][A-Za-z]?[a-z]+)+"))
#: Identifiers within a longer candidate, which is cut there.
UUID_PART = re.compile(rf"(?<![A-Za-z0-9]){UUID}(?![A-Za-z0-9])")
#: Placeholders: a window that holds one is no secret, the rest of its candidate may be. All starts are found.
PLACEHOLDER = re.compile(r"(?=(example|placeholder|changeme|xxxx|0000|1234567))", re.I)


def entropy_windows(text: str, width: int, least: float, barred: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Maximal spans of ``text`` covered by windows of ``width`` characters with ``least`` bits each, but
    for windows that hold one of the ``barred`` spans (in order of start).

    The window's character counts are kept by adding one character and dropping one; with them the sum
    of c * log2(c), from which the entropy follows. A text shorter than the window is one window.
    """
    width = min(width, len(text))
    counts: dict[str, int] = {}
    weight = lambda c: c * log2(c) if c else 0.0
    total, spans = 0.0, []
    # The first end of a barred span from each one on, and the next one that no window has passed.
    ends, following = [b for _, b in barred], 0
    for k in range(len(ends) - 2, -1, -1):
        ends[k] = min(ends[k], ends[k + 1])
    for end, char in enumerate(text):
        c = counts.get(char, 0)
        total += weight(c + 1) - weight(c)
        counts[char] = c + 1
        if end >= width:
            old = text[end - width]
            c = counts[old]
            total += weight(c - 1) - weight(c)
            counts[old] = c - 1
        if end >= width - 1 and log2(width) - total / width >= least - 1e-9:
            start = end - width + 1
            while following < len(ends) and barred[following][0] < start:
                following += 1
            if following < len(ends) and ends[following] <= end + 1:
                continue
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end + 1)
            else:
                spans.append((start, end + 1))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, code points, end exclusive; too short ones are dropped."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN] if ":" in text or "=" in text else []
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    """High-entropy parts of the candidates, judged by each class on its own runs of characters. The
    allow-list suppresses the candidate, run or window that it matches and nothing beside it."""
    out: list[tuple[str, int, int]] = []
    for m in CANDIDATE.finditer(text):
        if any(p.fullmatch(m[0]) for p in ALLOWED):
            continue
        found, at = [], m.start()
        for cut in [*UUID_PART.finditer(text, *m.span()), None]:
            found += [(at + a, at + b) for a, b in part_spans(text[at : cut.start() if cut else m.end()])]
            at = cut.end() if cut else at
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out += [("entropy", a, b) for a, b in merged]
    return out


def part_spans(part: str) -> list[tuple[int, int]]:
    """Spans of the windows of every class within a part of a candidate."""
    found = []
    for _, pattern, width, least in CLASSES:
        for run in pattern.finditer(part):
            if len(run[0]) >= LEAST_RUN and not any(p.fullmatch(run[0]) for p in ALLOWED):
                barred = [p.span(1) for p in PLACEHOLDER.finditer(run[0])]
                found += [(run.start() + a, run.start() + b) for a, b in entropy_windows(run[0], width, least, barred)]
    return found


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base and added spans of one text; null counts as empty."""
    text = text or ""
    return base_spans(text), entropy_spans(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All secrets of each whole text: id, spans array of (kind, start, end), in order.

    One row per row; null and empty texts have no spans.
    """

    def start():
        def one(doc, text):
            base, more = scan(text)
            return doc, [{"kind": k, "start": a, "end": b} for k, a, b in ordered(base + more)]

        return one

    return map_rows(docs, start, f"{id_col} long, spans array<struct<kind:string,start:int,end:int>>", [id_col, text_col])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same spans, counted and written out: id, n_assign, n_access, n_hex, base_sha256, spans.

    One row per row, repeats included. Null and empty texts have counts of zero, the hash of the empty
    string and no spans.
    """

    def start():
        def one(doc, text):
            base, more = scan(text)
            kinds = [s[0] for s in base]
            return doc, *map(kinds.count, KINDS[:3]), sha256(written(base).encode()).hexdigest(), written(base + more)

        return one

    return map_rows(docs, start, f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", [id_col, text_col])
