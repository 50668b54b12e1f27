import random

import numpy as np
import pytest
import xxhash

from lumenshelf.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    label = list(ids)
    while True:
        new = [min(label[j] for j in range(len(ids)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(ids))]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two three", "one two three four", "A b C d E f", "x " * 5000, "ß Ä é a b c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 31 and all((m & (1 << 64) - 1).bit_count() == 32 for m in masks)
    rnd = random.Random(1)
    for _ in range(3000):
        difference = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(m & difference == 0 for m in masks)


@pytest.mark.parametrize("bucket_rows", [2048, 2])
def test_links_give_exact_components(spark, bucket_rows):
    """Chains, stars and crowds, also when every bucket of three or more counts as crowded."""
    rnd = random.Random(7)
    prints = [rnd.getrandbits(64) for _ in range(30)]
    for _ in range(150):
        value = rnd.choice(prints)
        for b in rnd.sample(range(64), rnd.randint(1, 5)):
            value ^= 1 << b
        prints.append(value)
    prints = sorted(set(prints))
    signed = [int(np.array(p, np.uint64).view(np.int64)) for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket_rows=bucket_rows)
    roots = {r["node"]: r["root"] for r in simhash.connected_components(links).collect()}
    slow = slow_components(signed, prints)
    assert [roots.get(p, p) for p in signed] == slow


def test_against_brute_force(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(make_docs(rows)).collect()}
    prints = {r[0]: slow_fingerprint(r[1]) for r in rows}
    ids = sorted(prints)
    want = dict(zip(ids, slow_components(ids, [prints[i] for i in ids])))
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_null_ids_and_drop(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(odd_rows)
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {3, None}
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} >= {1, 3, 6, 8, 9}
    assert not {r["doc_id"] for r in out.collect()} & {4, 5, 7}


def test_drop_judges_each_text_for_itself(make_docs, odd_rows):
    """Clean texts stay beside a near copy that has a null id too, or the same id."""
    out = {(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(make_docs(odd_rows)).collect()}
    assert (None, "a text without an id") in out and (None, None) not in out and (3, None) in out
    fox = odd_rows[0][1]
    shared = [(1, fox, "en", "a"), (2, fox.upper(), "en", "a"), (2, "something else that nobody copied from anyone", "en", "a"), (3, "one copy", "en", "a"), (3, "One  copy", "en", "a")]
    out = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(make_docs(shared)).collect()]
    assert (1, fox) in out and shared[2][:2] in out and shared[1][:2] not in out
    assert len(out) == 3 and [i for i, _ in out].count(3) == 1


def test_near_copies_without_any_id_leave_one(make_docs):
    rows = [(None, t, "en", "a") for t in ("the same words", "The same words", "the  same words", "quite another text")]
    out = [r["text"] for r in simhash.drop_near_duplicates(make_docs(rows)).collect()]
    assert len(out) == 2 and "quite another text" in out


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []
    assert simhash.drop_near_duplicates(make_docs([])).collect() == []
