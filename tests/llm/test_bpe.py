import random
from hashlib import sha256

import pytest

from lumenshelf.llm import bpe
from lumenshelf.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


PARTS = ["a", "Σ", "İ", "́", "é", " ", "\n", " ", " ", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", "9", "٣", "漢", "😀", "ß", "\x85", "\x00", "\x1c", "½", "_", "K", "ſ", "Ⅷ", "word", "Hello"]


def test_like_the_library_on_random_texts(library):
    words, rnd = bpe.vocabulary(vocabulary_path()), random.Random(3)
    for _ in range(2000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == ids, repr(text)
        assert words.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merges_skip_stale_entries():
    words = bpe.vocabulary(vocabulary_path())
    ids = words.merge([words.ids[c] for c in [*"aaaaaaaaab", "c</w>"]])
    assert "".join(words.strings[i] for i in ids) == "aaaaaaaaabc</w>"


def test_rows(make_docs, odd_rows, library):
    docs = make_docs(odd_rows)
    got = [tuple(r) for r in bpe.digests(docs, vocabulary_path()).collect()]
    want = []
    for i, text, _, _ in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    encoded = bpe.encode(docs, vocabulary_path())
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(encoded, vocabulary_path()).collect()}
    assert back[9] == library.decode(library.encode("one", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.digests(make_docs([]), vocabulary_path()).collect() == []


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    words = bpe.Vocabulary(vocabulary_path())
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a + b for a in letters for b in letters) + " ab cd" * 20
    ids = words.encode(text)
    assert len(words.cache) <= 5 and len(words.older) <= 5
    assert ids == tokenizers.Tokenizer.from_file(vocabulary_path()).encode(text, add_special_tokens=False).ids
