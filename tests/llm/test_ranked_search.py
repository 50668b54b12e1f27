import math
import random
from collections import Counter

import numpy as np
import pytest

from lumenshelf.llm import ranked_search

ITEMS = "item_id long, text string, doc_id long, rank int, score long, doc long, no long, c long"


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in rows], ITEMS)


def terms(text):
    out, word = [], ""
    for c in text or "":
        if ord(c) >= 128 or c.isascii() and c.isalnum():
            word += c.lower() if c.isascii() else c
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def plain(docs, asked, k=10):
    """Every document scored for every item."""
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in set(asked):
        found = []
        for i, b in bags:
            tf, m = Counter(b), 10 + 90 * len(b) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if t in tf)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: f[:2] + (f[2] or 0,))[:k])]
    return sorted(out, key=str)


def got(docs, asked, k=10):
    return sorted((tuple(r) for r in ranked_search.search(docs, asked, k).collect()), key=str)


def test_odd_rows(spark, make_docs, odd_rows):
    asked = [(1, "The QUICK fox"), (2, None), (3, ""), (4, "nothingofthekind"), (None, "one lazy ünïcödé ß 漢字"), (5, "word3 x9 word3"), (5, "dog"), (1, "The QUICK fox"), (6, "Ü ÜNÏCÖDÉ straße ßtraße 😀")]
    result = ranked_search.search(make_docs(odd_rows), items(spark, asked))
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, result.collect()), key=str) == plain([r[:2] for r in odd_rows], asked)


def test_nothing_to_search(spark, make_docs):
    assert got(make_docs([]), items(spark, [(1, "a")])) == []
    assert got(make_docs([(1, "a b", "en", "a")]), items(spark, [])) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpus(spark, make_docs, seed):
    rnd = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(k, " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 5, 40, 200]))), "en", "a") for k in range(250)]
    docs += [(1000 + k, docs[7][1], "en", "a") for k in range(60)]  # a group of copies that tie
    asked = [(k, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 12, 30])))) for k in range(25)] + [(99, docs[7][1])]
    assert got(make_docs(docs).repartition(5), items(spark, asked), 3 if seed == 1 else 10) == plain([d[:2] for d in docs], asked, 3 if seed == 1 else 10)


def test_many_terms_and_items_go_in_blocks(spark, make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(ranked_search, "MAX_PICKED", 1)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 4)
    monkeypatch.setattr(ranked_search, "SCORES_AT_ONCE", 5)
    asked = [(1, "The quick fox"), (2, "one"), (3, "again and word5")]
    assert got(make_docs(odd_rows), items(spark, asked)) == plain([r[:2] for r in odd_rows], asked)


def test_thresholds_fetch_less_than_all():
    """Two rare terms and a common one: phase two leaves the common list below the threshold unread."""
    asked = ranked_search.Questions.of([(7, 0, 100), (7, 1, 900), (7, 2, 800), (8, 2, 800)]).above({7: 1500, 8: 790})
    assert dict(asked.floors()) == {0: 500, 1: 500, 2: 500}
    assert asked.unseen.tolist() == [100 + 499 + 499, 789]
    low, seen = asked.sums(np.array([2, 1]), np.array([0, 2, 1]), np.array([90, 795, 400]), True)
    assert low.tolist() == [[795, 795], [0, 0]] and seen.tolist() == [[1, 1], [0, 0]]
    whole, _ = asked.sums(np.array([2, 1]), np.array([0, 2, 1]), np.array([90, 795, 400]), False)
    assert whole.tolist() == [[885, 795], [400, 0]]
