"""Text out of document files: plain text, RTF, DOCX, ODT and PDF, in Arrow batches."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
import zlib
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.workers import map_arrow
from lumenshelf.operators.features import excerpt

# Bytes of text that are kept, bytes of a container that is opened at all, pages of a PDF.
MAX_TEXT, MAX_CONTAINER, MAX_PAGES = 1 << 20, 64 << 20, 2000
XML_PARTS = {"docx": "word/document.xml", "odt": "content.xml"}
RTF_BREAKS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "tab": "\t"}
RTF_HIDDEN = frozenset(("pict", "fonttbl", "colortbl", "stylesheet", "info"))

RTF = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}]+)", re.S)
PDF_STREAM = re.compile(rb"<<(?P<dict>(?:[^<>]|<[^<]|>[^>]|<<(?:[^<>]|<[^<]|>[^>])*>>)*)>>\s*stream\r?\n(?P<data>.*?)\r?\n?endstream", re.S)
PDF_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[A-Za-z'\"*]+|-?\d*\.?\d+|/[^\s/<>\[\]()]+", re.S)
PDF_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
PDF_CHARS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def western(data: bytes) -> str:
    """Windows-1252, whose five unassigned bytes stand for themselves."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data) if any(b in data for b in b"\x81\x8d\x8f\x90\x9d") else data.decode("cp1252")


def plain(data: bytes) -> str:
    """By its byte order mark, else UTF-8, else Windows-1252. A character cut off at the limit is left out."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) : MAX_TEXT].decode(name, "replace")
    whole = len(data) <= MAX_TEXT
    try:
        return codecs.getincrementaldecoder("utf-8")().decode(data[:MAX_TEXT], final=whole)
    except UnicodeDecodeError:
        return western(data[:MAX_TEXT])


def rtf(data: bytes) -> str | None:
    """Text between control words. Groups of pictures, fonts, colours, styles and document facts, and those marked
    as destinations (``\\*``), are hidden; characters given by number take the place of their substitutes."""
    if not data.lstrip().startswith(b"{\\rtf"):
        return None
    out, hidden, substitutes, left = [], [False], [1], 0
    for word, number, octet, sign, brace, text in RTF.findall(plain(data)):
        if brace == "{":
            hidden.append(hidden[-1])
            substitutes.append(substitutes[-1])
            continue
        if brace == "}":
            if len(hidden) > 1:
                hidden.pop()
                substitutes.pop()
            left = 0
            continue
        if word in RTF_HIDDEN or sign == "*":
            hidden[-1] = True
        if word == "uc":
            substitutes[-1] = int(number or 1)
        if hidden[-1]:
            continue
        if word == "u" and number:
            out.append(chr(int(number) % 65536))
            left = substitutes[-1]
        elif word in RTF_BREAKS:
            out.append(RTF_BREAKS[word])
        elif octet or sign in ("\\", "{", "}", "~"):
            if left:
                left -= 1
            else:
                out.append(western(bytes.fromhex(octet)) if octet else " " if sign == "~" else sign)
        elif text:
            out.append(text[left:])
            left = max(left - len(text), 0)
    # Characters beyond the basic plane come as two halves.
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def marked_up(xml: bytes) -> str:
    """Text of a word processor's XML: paragraphs and headings end lines, breaks and tabs are kept. What comes
    before an error stands."""
    out: list[str] = []
    local = lambda name: name.rpartition(":")[2]

    def end(name: str) -> None:
        out.append({"p": "\n", "h": "\n", "br": "\n", "line-break": "\n", "tab": "\t"}.get(local(name), ""))

    parser = expat.ParserCreate()
    parser.CharacterDataHandler, parser.EndElementHandler = out.append, end
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        pass
    return "".join(out)


def zipped(data: bytes, part: str) -> str | None:
    if len(data) > MAX_CONTAINER:
        return None
    with zipfile.ZipFile(io.BytesIO(data)) as box, box.open(part) as entry:
        return marked_up(entry.read(MAX_TEXT))


def pdf_string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = PDF_ESCAPE.sub(lambda m: PDF_CHARS.get(m[1]) or (b"" if m[1].strip() == b"" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1])
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else western(raw)


def pdf(data: bytes) -> str | None:
    """The strings that text operators show, in the order of the file's content streams. Text operators that move
    to another line end a word; a wide gap inside an array is a space. Encrypted files and fonts with codes of their own are not read."""
    if not data.startswith(b"%PDF") or b"/Encrypt" in data or len(data) > MAX_CONTAINER:
        return None
    out, size, pages = [], 0, 0
    for m in PDF_STREAM.finditer(data):
        kind = m["dict"]
        if re.search(rb"/(Image|XRef|ObjStm|Metadata|FontFile\d?|Length1)\b", kind) or (b"/Filter" in kind and b"FlateDecode" not in kind):
            continue
        try:
            body = zlib.decompressobj().decompress(m["data"], 8 * MAX_TEXT) if b"FlateDecode" in kind else m["data"]
        except zlib.error:
            continue
        if not re.search(rb"\bBT\b", body) or pages >= MAX_PAGES or size >= MAX_TEXT:
            continue
        pages += 1
        held, inside = [], False
        for token in PDF_TOKEN.findall(body):
            if token in (b"BT", b"ET"):
                inside, held = token == b"BT", []
                out.append("\n")
            elif not inside:
                continue
            elif token[:1] in b"(<":
                held.append(pdf_string(token))
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                out.append(("\n" if token in (b"'", b'"') else "") + "".join(held))
                size += len(out[-1])
                held = []
            elif token in (b"Td", b"TD", b"T*", b"Tm"):
                out.append("\n")
            elif held and re.fullmatch(rb"-\d{3,}\.?\d*", token):
                held.append(" ")
    return "".join(out)


def document_text(data: bytes | None, kind: str | None) -> str | None:
    """The text of a file of this format, each run of white space one space, at most 1 MiB. Null where the file is
    null, broken, of another format, or has no text."""
    if data is None:
        return None
    try:
        if kind in ("txt", "md"):
            found = plain(data)
        elif kind in XML_PARTS:
            found = zipped(data, XML_PARTS[kind])
        else:
            found = {"rtf": rtf, "pdf": pdf}.get(kind or "", lambda _: None)(data)
    except (zipfile.BadZipFile, KeyError, NotImplementedError, RuntimeError, zlib.error, ValueError, EOFError):
        return None
    flat = " ".join((found or "").split())
    return flat.encode("utf-8", "replace")[:MAX_TEXT].decode("utf-8", "ignore") or None


def texts(files: DataFrame, id_col: str = "id", format_col: str = "format", content_col: str = "content") -> DataFrame:
    """id, text and excerpt of document files (bytes). One row per row; files are worked through one by one."""

    def run(batches):
        for batch in batches:
            ids, kinds, contents = batch.columns
            for at in range(0, batch.num_rows, 64):
                found = [document_text(c.as_py(), k.as_py()) for c, k in zip(contents.slice(at, 64), kinds.slice(at, 64))]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 64), pa.array(found, pa.string())], [id_col, "text"])

    rows = files.select(F.col(id_col).cast("long").alias(id_col), format_col, content_col)
    return map_arrow(rows, run, f"{id_col} long, text string").withColumn("excerpt", excerpt(F.col("text")))
