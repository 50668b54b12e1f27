import io
import zipfile
import zlib

from lumenshelf.operators.documents import MAX_TEXT, document_text, texts


def zipped(name, body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        box.writestr("[Content_Types].xml", "<Types/>")
        box.writestr(name, body)
    return out.getvalue()


DOCX = zipped("word/document.xml", '<?xml version="1.0"?><w:document xmlns:w="x"><w:body><w:p><w:r><w:t>First &amp; line</w:t><w:br/><w:t>second</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>')
ODT = zipped("content.xml", '<office:document-content xmlns:office="o" xmlns:text="t"><text:h>Head</text:h><text:p>one<text:line-break/>two <text:span>three</text:span></text:p></office:document-content>')
RTF = rb"{\rtf1\ansi{\fonttbl{\f0 Times;}}{\*\generator hidden}{\info{\title no}}\f0 Caf\'e9 \b bold\b0  text\par\tab \{braces\} \u8364? \uc2\u-10179??\u-8704??{\pict 89504e}end\par}"


def paged(*contents, packed=True):
    out = b"%PDF-1.4\n"
    for k, body in enumerate(contents):
        data = zlib.compress(body) if packed else body
        out += b"%d 0 obj\n<< /Length %d %s>>\nstream\n" % (k + 1, len(data), b"/Filter /FlateDecode " if packed else b"") + data + b"\nendstream\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_each_format():
    assert document_text(DOCX, "docx") == "First & line second a b"
    assert document_text(ODT, "odt") == "Head one two three"
    assert document_text(RTF, "rtf") == "Café bold text {braces} € 😀end"
    assert document_text("Zeile\r\n\tzwei ü".encode(), "txt") == "Zeile zwei ü"
    assert document_text("caf\u00e9".encode("cp1252") + b"\x81", "txt") == "café\x81"
    for codec in ("utf-8-sig", "utf-16"):
        assert document_text("# Titel 漢".encode(codec), "md") == "# Titel 漢"
    for packed in (True, False):
        page = rb"q BT /F1 12 Tf 72 700 Td (Hello \(wide\) w\157rld) Tj 0 -14 Td [(spl)-20(it)-400(word)] TJ T* <48 69> Tj ET Q (no)"
        assert document_text(paged(page, b"1 0 0 rg", b"BT (next) ' ET", packed=packed), "pdf") == "Hello (wide) world split word Hi next"


def test_broken_files_have_no_text():
    for kind, data in [("docx", DOCX[:80]), ("docx", zipped("other.xml", "x")), ("odt", b""), ("rtf", b"no rtf"), ("pdf", b"no pdf"), ("pdf", paged(b"BT (x) Tj ET").replace(b"trailer", b"/Encrypt trailer")), ("txt", b" \n "), ("exe", b"MZ"), ("txt", None), (None, b"a")]:
        assert document_text(data, kind) is None, (kind, data)
    assert document_text(zipped("word/document.xml", "<w:p>kept</w:p><w:p>"), "docx") == "kept"
    assert document_text(paged(b"BT (x) Tj ET").replace(b"x\x9c", b"zz", 1), "pdf") is None


def test_long_files_are_cut():
    assert len(document_text(("é" * MAX_TEXT).encode(), "txt").encode()) == MAX_TEXT
    assert len(document_text(zipped("content.xml", "<p>" + "word " * MAX_TEXT + "</p>"), "odt")) <= MAX_TEXT


def test_rows(spark):
    rows = [(1, "docx", bytearray(DOCX)), (2, "pdf", bytearray(b"%PDF")), (3, "txt", None), (None, "txt", bytearray(b"word " * 200)), (1, "docx", bytearray(DOCX))]
    got = sorted((tuple(r) for r in texts(spark.createDataFrame(rows, "id long, format string, content binary")).collect()), key=str)
    assert [r[0] for r in got] == [1, 1, 2, 3, None] and got[0][1] == "First & line second a b" and got[2][1] is None
    assert got[-1][2].endswith("…") and len(got[-1][2]) <= 281
