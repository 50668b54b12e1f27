import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenshelf.llm import token_files

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def there_and_back(ids, block):
    words, escapes, word_at, _ = token_files.pack(np.array(ids, np.uint64), block)
    return words, token_files.unpack(words, escapes, word_at, len(ids), block).tolist()


SIZES = st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**32 - 1), st.integers(0, 2**64 - 1))


@given(st.lists(st.one_of(SIZES, st.lists(st.just(0), min_size=100, max_size=300)), max_size=60), st.sampled_from([1, 7, 256, 4096]))
@settings(max_examples=150, deadline=None)
def test_round_trip(parts, block):
    ids = [x for p in parts for x in (p if isinstance(p, list) else [p])]
    assert there_and_back(ids, block)[1] == ids


def test_words_hold_varying_counts():
    assert len(there_and_back([0] * 240, 4096)[0]) == 1
    assert len(there_and_back([2] * 30, 4096)[0]) == 1
    assert len(there_and_back([30_000] * 4, 4096)[0]) == 1
    assert len(there_and_back([50_000] * 3, 4096)[0]) == 1
    # One wide id among narrow ones is an escape, and the others keep their width.
    words, escapes, _, _ = token_files.pack(np.array([1] * 10 + [2**63] + [1] * 19, np.uint64))
    assert len(words) == 1 and escapes.tolist() == [2**63]


def slow_words(ids, block):
    """The selector of each word, one after another; of equal ones the widest, up to one that takes all ids."""
    limits = [max((1 << width) - 1, 1) for width in token_files.WIDTHS.tolist()]
    last = min([s for s, limit in enumerate(limits) if limit > max(ids)], default=15)
    out = []
    for at in range(0, len(ids), block):
        row, k = ids[at : at + block], 0
        while k < len(row):
            best, pick = 0, None
            for s in range(last, -1, -1):
                count = int(token_files.COUNTS[s])
                wide = sum(x >= limits[s] for x in row[k : k + count])
                worth = 0 if wide and s < 2 else min(count, len(row) - k) / (wide + 1)
                if worth > best:
                    best, pick = worth, s
            out.append(pick)
            k += int(token_files.COUNTS[pick])
    return out


@pytest.mark.parametrize("top", [0, 1, 2, 50_000, 2**20 - 2, 2**20 - 1, 2**33, 2**60 - 1, 2**64 - 1])
def test_the_best_selector_wins_at_each_word(top):
    rnd = random.Random(top)
    ids = [min(top, rnd.choice([0, 0, 1, 3, 200, 5000, top, rnd.randint(0, top)])) for _ in range(900)] + [0] * 300 + [top]
    for block in (64, 256, 4096):
        words = there_and_back(ids, block)[0]
        assert (words >> np.uint64(60)).tolist() == slow_words(ids, block)


def test_a_file_is_read_in_parts():
    rnd = random.Random(4)
    tokens = [np.array([rnd.choice([0, 5, 300, 50_000, 2**40]) for _ in range(rnd.choice([1, 3, 5000, 9000]))], np.uint64) for _ in range(12)]
    file = token_files.TokenFile(token_files.TokenFile.build([None, *range(11)], tokens, 17))
    flat = np.concatenate(tokens)
    for a, b in ((0, 1), (4095, 4097), (100, 100), (5000, len(flat)), (len(flat) - 1, len(flat))):
        assert (file.read(a, b) == flat[a:b]).all()
    for at_once in (1, 4096, 1 << 18):
        got = list(file.documents(at_once))
        assert [k for k, _, _ in got] == [None, *range(11)]
        assert all((g == t).all() for (_, _, g), t in zip(got, tokens, strict=True))
        assert [s for _, s, _ in got] == [17 + sum(map(len, tokens[:k])) for k in range(12)]
    with pytest.raises(ValueError):
        token_files.TokenFile(b"x" * 100)


PIECES = ["a", "the", " ", "  ", "\n", ".\n", "\nTo", "word,", "\t", " \n", "\x85", "\xa0", " ", "\x1c", "​", "<|endoftext|>", "<|", "'s", "'LL", " '", "9", "٣", "漢", "😀", "é", "́", "_", "-", "\x00", "İ"]


def test_words_make_the_ids_of_whole_texts(library, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 50)
    monkeypatch.setattr(token_files, "RUN_CHARS", 500)
    encode, rnd = token_files.Encoder(PATH), random.Random(8)
    assert encode.by_piece
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    for text, ids in zip(texts, encode.encode_all(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    for text in texts[:1000]:
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    for kept in (encode.first, encode.after):
        assert len(kept) <= 50 and len(kept.older) <= 50
    lines = "word,\n" * 5000 + "\n".join("ab" for _ in range(40))
    assert np.frombuffer(encode.encode(lines), "<u4").tolist() == library.encode(lines, add_special_tokens=False).ids


def test_other_vocabularies_take_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = token_files.Encoder(path)
    text = "Some words  and <|endoftext|> more"
    assert not encode.by_piece
    want = tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode.encode(text), "<u4").tolist() == want
    assert [ids.tolist() for ids in encode.encode_all(pa.array([text, "", text]))] == [want, [], want]


def wanted(rows, library):
    """The contract with a loop; rows of one id stand in the order of a hash, so they are compared as a set."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_rows(make_docs, odd_rows, library, tmp_path, monkeypatch):
    rows = [r for r in odd_rows if r[0] is not None] + [(None, "a text without an id", "en", "b")]
    docs = make_docs(rows).repartition(3)
    got = token_files.digests(docs, PATH, str(tmp_path / "a"))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(wanted([r[:2] for r in rows], library), key=str)
    assert len(list((tmp_path / "a" / "tokens").glob("part-*"))) >= 1
    assert token_files.digests(make_docs([]), PATH, str(tmp_path / "b")).collect() == []


def test_many_files_and_shared_ids(make_docs, library, tmp_path):
    rows = [(k // 3, f"text {k} " * (k % 40), "en", "a") for k in range(900)]
    token_files.write_token_files(make_docs(rows), PATH, str(tmp_path), file_ids=500)
    spark = make_docs([]).sparkSession
    got = token_files.read_token_files(spark, str(tmp_path), lambda key, start, ids: (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), "doc_id long, start long, n long, crc long").collect()
    assert len(list((tmp_path / "tokens").glob("part-*"))) > 8
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(k // 3 for k in range(900))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    key = lambda r: (r[0], r[2], r[3])
    assert sorted(map(key, got)) == sorted(map(key, wanted([r[:2] for r in rows], library)))
