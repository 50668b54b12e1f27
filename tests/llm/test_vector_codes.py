import math
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from lumenshelf.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id long, code string, error long, n long, trees string"


def plain(rows, entries=256, rounds=4):
    """The contract with plain loops over Python integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    d = len(kept[0][1]) // 4
    part = lambda v, k: v[k * d : (k + 1) * d]
    books = [[part(v, k) for _, v, _ in kept[:entries]] for k in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, book: min(range(len(book)), key=lambda e: (far(p, book[e]), e))
    for _ in range(rounds):
        for k in range(4):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(part(v, k), books[k])].append(part(v, k))
            books[k] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[k])]
    out, by_label = [], defaultdict(int)
    for i, v, lab in kept:
        codes = [near(part(v, k), books[k]) for k in range(4)]
        error = sum(far(part(v, k), books[k][c]) for k, c in enumerate(codes))
        by_label[lab] += error
        out.append((i, "".join(f"{c:02x}" for c in codes), error, lab))
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 7, "c", 8, 9, "t") for i, v, lab in rows], SCHEMA)


def both(spark, rows):
    return sorted((tuple(r) for r in vector_codes.digests(table(spark, rows)).collect()), key=str), plain(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).tolist(), k % 3 if k % 5 else None) for k in range(300)]
    rows += [(k, rows[1][1], 1) for k in range(400, 520)]  # a hot vector, many ties
    rows += [(900, None, 1), (901, [None] * 8, 1), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("-inf")] * 8, 2), (None, [0.5] * 8, None), (3, rows[3][1], 0), (3, rows[4][1], 0)]
    got, want = both(spark, rows)
    assert got == want


def test_few_rows_and_none(spark):
    got, want = both(spark, [(2, [0.1, 0.2, 0.3, 0.4], None), (1, [0.1, 0.2, 0.3, -0.4], None)])
    assert got == want
    assert vector_codes.digests(table(spark, [])).collect() == []
    assert vector_codes.digests(table(spark, [(1, None, 2)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_large_components_stay_exact(spark):
    rows = [(k, [float(k * 3_000_017), 1.0 * k, -5e6 * (k % 3), 0.25], 1) for k in range(60)]
    got, want = both(spark, rows)
    assert got == want


def test_lengths_that_differ_are_padded(spark):
    got, _ = both(spark, [(1, [1.0] * 8, 1), (2, [2.0] * 8, 1)])
    short = vector_codes.digests(table(spark, [(1, [1.0] * 8, 1), (2, [2.0] * 5, 1), (3, [], 1)])).collect()
    assert len(got) == 2 and [r["error"] for r in short] == [0, 0, 0]


@pytest.mark.parametrize("spread", [0, 1, 40])
def test_trees_assign_like_a_full_search(spread, monkeypatch):
    monkeypatch.setattr(vector_codes, "LEAF_POINTS", 4)
    rng = np.random.default_rng(spread)
    points, entries = rng.integers(-spread, spread + 1, (700, 5)).astype(float), rng.integers(-spread, spread + 1, (40, 5)).astype(object)
    tree = vector_codes.Tree(points)
    far = ((points[:, None, :] - entries.astype(float)[None]) ** 2).sum(axis=2)
    codes, errors = tree.codes(entries)
    assert (codes == far.argmin(axis=1)).all() and (errors == far.min(axis=1)).all()
    sums, counts = tree.sums(entries)
    for e in range(40):
        mine = points[codes == e]
        assert counts[e] == len(mine) and sums[e] == mine.sum(axis=0).tolist()
    whole = [b - a for node, a, b, _ in tree.assign(entries) if node >= 0]
    assert sum(whole) > 0  # some subtrees go to an entry at once


def test_rows_split_over_trees(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).round(1).tolist(), k % 2) for k in range(700)]
    coded, books = vector_codes.compress(table(spark, rows), entries=16)
    got = {r["id"]: r["code"] for r in coded.collect()}
    back = {r["id"]: r["vec"] for r in vector_codes.decompress(coded, books).collect()}
    for k in (0, 99, 500):
        assert back[k] == [float(books[p][c, 0]) / 1024 for p, c in enumerate(got[k])]
    assert len(got) == 700
