import pytest

#: Names that operators give to columns of their own.
CLASHES = "size group_size fp id kept _idk _raw _hash _k1 _k2 _k3 _k4 _sk _lk tk spans text_sha256 hash data term doc n c0 c1 position copies taken".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHES)


@pytest.fixture
def make_docs(spark):
    """Documents with extra columns whose names clash with those that operators make."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), *range(len(CLASHES))) for i, t, lang, source in rows], SCHEMA)

    return make


LONG = " ".join(f"word{k % 997} x{k}" for k in range(60_000))


@pytest.fixture
def clashes_kept():
    """Whether rows that came through an operator still hold what make_docs put into the clashing columns."""
    return lambda rows: all([r[c] for c in CLASHES] == [*range(len(CLASHES))] for r in rows)


@pytest.fixture
def odd_rows():
    """Null ids, texts, languages and sources; empty, blank and very long texts; repeated rows; ties."""
    return [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, "The quick  brown fox\tjumps over the lazy dog again and again", "en", "b"),
        (2, "The quick  brown fox\tjumps over the lazy dog again and again", "en", "b"),
        (3, None, None, None),
        (4, "", "de", "a"),
        (5, " \n\t ", None, "a"),
        (None, "a text without an id", "en", "b"),
        (None, None, None, None),
        (6, LONG, "en", "c"),
        (7, LONG, "en", "c"),
        (8, "Ünïcödé ßtraße — 漢字 😀", "de", None),
        (9, "one", "en", "a"),
    ]
