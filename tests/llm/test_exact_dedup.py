import hashlib
import re

from lumenshelf.llm import common, exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _, _ in rows]
    out = []
    for (i, *_), t in zip(rows, norm):
        ids = [r[0] for r, u in zip(rows, norm) if u == t]
        known = [x for x in ids if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_against_brute_force(make_docs, odd_rows):
    got = [tuple(r) for r in exact_dedup.exact_duplicates(make_docs(odd_rows)).collect()]
    assert sorted(got, key=key) == sorted(brute(odd_rows), key=key)


def test_large_key_tables_go_by_shuffle(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup.sized, "__defaults__", (0,))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(make_docs(odd_rows)).collect()]
    assert sorted(got, key=key) == sorted(brute(odd_rows), key=key)


def test_drop_leaves_one_of_each(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    # of the blank texts 5 stays, of the empty ones 3, of the repeated row one
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out.collect()) == sorted((i is None, i) for i in (1, 3, 5, None, 6, 8, 9))


def test_clashing_columns_come_back(make_docs, odd_rows, clashes_kept):
    assert clashes_kept(exact_dedup.drop_exact_duplicates(make_docs(odd_rows * 2)).collect())


def test_empty_table(make_docs):
    assert exact_dedup.exact_duplicates(make_docs([])).collect() == []
    assert exact_dedup.drop_exact_duplicates(make_docs([])).collect() == []


def test_only_survivors_are_hashed_in_full_whatever_the_slots(make_docs, odd_rows, monkeypatch):
    rows = odd_rows + [(100 + k, f"text number {k} " * (1 + k % 7), "en", "s") for k in range(200)] + [(500, "text number 3  text number 3 text number 3 text number 3 ", "en", "s")]
    docs = make_docs(rows)
    want = sorted(map(str, exact_dedup.exact_duplicates(docs).collect()))
    hashed = exact_dedup.duplicate_candidates(docs).count()
    assert hashed < 60  # the pairs of length and prefix hash that recur, and little beside them
    monkeypatch.setattr(exact_dedup, "MOST_SLOTS", 64)
    assert sorted(map(str, exact_dedup.exact_duplicates(docs).collect())) == want
    assert hashed <= exact_dedup.duplicate_candidates(docs).count()
