import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from lumenshelf.llm import repeats


def brute(texts, length):
    """n_bytes, n_removed, n_spans, hash of what is kept, from all windows of all texts."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + length, bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(t)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_index_finds_all_repeated_windows():
    for seed in range(200):
        rnd = random.Random(seed)
        length = rnd.choice([8, 20, 50])
        base = [bytes(rnd.choices(b"ab" if seed % 2 else b"abcdefgh", k=rnd.randint(1, 150))) for _ in range(4)]
        texts = [b"".join(b[rnd.randint(0, len(b) // 2) :] if rnd.random() < 0.5 else bytes(rnd.choices(b"abc", k=rnd.randint(0, 30))) for b in rnd.choices(base, k=3)) for _ in range(rnd.randint(1, 8))]
        counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1) if counts[t[i : i + length]] > 1]
        assert [(k, i) for k, a, b in repeats.repeated_windows(texts, length) for i in range(a, b)] == want


def test_transform_is_run_compressed():
    text = b"abracadabra" * 40 + repeats.BORDER
    index = repeats.RunIndex(text, 512)
    assert index.runs < 40 and len(index.heads) == len(index.tails) == index.runs - 1
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert index.order.tolist() == order


@pytest.mark.parametrize("size", repeats.KEYS)
def test_names_depend_on_the_window_alone(size):
    rnd = random.Random(size)
    body = bytes(rnd.choices(b"abcdefghij ", k=900))
    by_window = {}
    for lead in (b"", b"x" * 57, bytes(rnd.choices(b"abcdefghij ", k=333))):
        data = lead + body
        for a, n, name in zip(*repeats.named_passages(data, size)):
            for i in range(a, a + n):
                assert by_window.setdefault(data[i : i + 200], name) == name
    assert sum(n for n in repeats.named_passages(body, size)[1]) == 701


def texts_with_repeats():
    rnd = random.Random(2)
    fresh = lambda k: "".join(rnd.choices("abcdefghijklmnop éß\n", k=k))
    shared, line = fresh(700), fresh(230)
    texts = [fresh(rnd.randint(0, 600)) + (shared[rnd.randint(0, 300) : rnd.randint(400, 700)] if k % 2 else "") + fresh(rnd.randint(0, 300)) for k in range(60)]
    texts += [line * 5, "ab" * 400, "z" * 1000, fresh(5000), texts[3], texts[3] + "!", fresh(100) + texts[5], shared, shared[:199], shared[:200]]
    return texts


@pytest.mark.parametrize("crowd", [4096, 5, 2, 1])
def test_against_brute_force(make_docs, odd_rows, crowd, monkeypatch):
    """Also where some names, or all, count as crowded, and with small indexes."""
    if crowd < 3:
        monkeypatch.setattr(repeats, "INDEX_BYTES", 5000)
    rows = [r for r in odd_rows if r[0] not in (6, 7)] + [(100 + k, t, "en", "s") for k, t in enumerate(texts_with_repeats())]
    out = repeats.remove_repeats(make_docs(rows), name_passages=crowd).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], sha256(r["kept"]).hexdigest()) for r in out)
    want = brute([(t or "").encode() for _, t, _, _ in rows], 200)
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, want))


def test_block_seams(make_docs):
    """Texts named in blocks of 250 windows, in the workers too, against all windows; and long texts seam by seam."""
    rows = [(k, t, "en", "s") for k, t in enumerate(texts_with_repeats())]
    out = repeats.remove_repeats(make_docs(rows), block_bytes=250).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], sha256(r["kept"]).hexdigest()) for r in out)
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, brute([t.encode() for _, t, _, _ in rows], 200)))
    data = bytes(random.Random(4).choices(b"abcdefgh ", k=(1 << 20) + 5000))
    for block in (1 << 18, 1 << 20):
        each = [np.repeat(names, counts) for _, counts, names in [repeats.named_passages(data, 32, 200, b) for b in (block, 1 << 30)]]
        assert (each[0] == each[1]).all() and len(each[0]) == len(data) - 199


def test_long_texts_and_empty_table(make_docs, odd_rows):
    got = {r["doc_id"]: r for r in repeats.digests(make_docs(odd_rows)).collect()}
    assert got[6]["n_removed"] == got[6]["n_bytes"] == len(odd_rows[8][1]) and got[6]["n_spans"] == 1
    assert got[6]["kept_sha256"] == sha256(b"").hexdigest()
    assert repeats.digests(make_docs([])).collect() == []
