import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from lumenshelf.llm import toxicity

CALM = "the house garden town river walks quiet morning people bread water stone light".split()
RUDE = "grobian lump schuft".split()


def labelled(n, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(CALM, k=rnd.randint(5, 40))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(RUDE))
        docs.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(bad)))
    return docs, labels


SCHEMA = "doc_id long, quality int, toxic int"


def test_learns_and_never_from_the_held_out_fold(make_docs, spark):
    docs, labels = labelled(600)
    extra = [(5000, "you GROBIAN and lump!!", "en", "a"), (5001, None, None, None), (5002, "", "en", "a"), (5003, "gr0bian sch.u.f.t you lump", "en", "b")]
    first = {r["doc_id"]: r for r in toxicity.toxicity(make_docs(docs + extra), spark.createDataFrame(labels, SCHEMA)).collect()}
    held = [r for r in first.values() if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (crc32(str(i).encode()) % 5 == 0) for i, r in first.items())
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.97
    assert first[5000]["predicted"] == 1 and first[5001]["predicted"] == first[5002]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in first.values())
    flipped = [(i, q, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    second = {r["doc_id"]: r["score"] for r in toxicity.toxicity(make_docs(docs + extra), spark.createDataFrame(flipped, SCHEMA)).collect()}
    assert second == {i: r["score"] for i, r in first.items()}


def test_features():
    make = toxicity.Features({"lump": 4.0, "grob*": 3.0})
    got = dict(zip(toxicity.FEATURES, make("You are a LUMP, grobian!! l.u.m.p grob1an sooo")))
    assert got["strongest"] == 4.0 and got["near_you"] > 0 and got["shouted"] > 0 and got["repeated_marks"] > 0 and got["disguised"] > 0 and got["disguised_hits"] > 0 and got["stretched"] > 0
    assert len(make(None)) == len(make("x " * 100_000)) == len(toxicity.FEATURES)
    assert make("") == [0.0] * len(toxicity.FEATURES)


def test_odd_rows_and_missing_classes(make_docs, odd_rows, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (8, 1, 0)], SCHEMA)
    rows = toxicity.toxicity(make_docs(odd_rows), labels).collect()
    assert len(rows) == len(odd_rows) and {r["score"] for r in rows} == {0.0}
    none = toxicity.toxicity(make_docs(odd_rows), spark.createDataFrame([], SCHEMA)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.toxicity(make_docs([]), labels).collect() == []


def slow_features(text, lexicon):
    """The features from their definitions, word by word."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    words = letters.split()
    weigh = lambda w: max([0.0, lexicon.get(w, 0.0), *[lexicon.get(w[:k] + "*", 0.0) for k in (4, 5, 6, 7) if len(w) > k]])
    weights = [weigh(w) for w in words]
    you = [w in toxicity.SECOND_PERSON for w in words]
    near = sum(1 for i, w in enumerate(weights) if w > 0 and any(you[max(0, i - 4) : i + 5]))
    disguised = toxicity.DISGUISED.findall(text.lower())
    hidden = [weigh(w) for d in disguised for w in "".join(c if c.isalpha() else " " for c in d.translate(toxicity.DISGUISE)).split()]
    hidden, hits = [w for w in hidden if w], [w for w in weights if w]
    n = max(1, len(words))
    upper = [c for c in text if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "À" <= c <= "Þ" and c != "×"]
    return [
        math.log1p(len(words)), (sum(weights) + sum(hidden)) / n, math.log1p(len(hits) + len(hidden)), max([0.0, *hits, *hidden]), (len(hits) + len(hidden)) / n, math.log1p(near), sum(you) / n,
        len(upper) / max(1, sum(map(len, words))), len(toxicity.SHOUTED.findall(text)) / n, sum(text.count(c) for c in "!?") / max(1, len(text)), len(re.findall("[!?][!?]+", text)) / n,
        len(disguised) / n, math.log1p(len(hidden)), sum(1 for _ in re.finditer(r"([^\W\d_])\1\1", text.lower())) / n,
    ]


def test_features_against_their_definitions():
    rnd = random.Random(3)
    lexicon = {"lump": 4.0, "grob*": 3.0, "schuft": 2.5, "böse*": 2.0}
    pool = CALM + RUDE + "you du LUMP Grobiane!! l.u.m.p gr0bian sooo BÖSEWICHT ?! --- 12 tu".split()
    make = toxicity.Features(lexicon)
    for _ in range(300):
        text = " ".join(rnd.choices(pool, k=rnd.randint(0, 40)))
        assert make(text) == pytest.approx(slow_features(text, lexicon), abs=1e-12)


def test_lexicon_against_counting(spark, monkeypatch):
    docs, labels = labelled(400)
    toxic = {i: t for i, _, t in labels}
    rows = spark.createDataFrame([(t, toxic[i]) for i, t, _, _ in docs], "text string, toxic long").repartition(5)
    counts = {y: Counter(e for i, t, _, _ in docs if toxic[i] == y for e in {e for w in t.lower().split() for e in toxicity.entries(w)}) for y in (0, 1)}
    size = Counter(toxic.values())
    odds = {e: math.log((n + 0.5) / (size[1] + 1)) - math.log((counts[0][e] + 0.5) / (size[0] + 1)) for e, n in counts[1].items() if n >= toxicity.LEAST_DOCUMENTS}
    want = {e: w for e, w in odds.items() if w >= toxicity.LEAST_WEIGHT}
    assert toxicity.learn_lexicon(rows) == pytest.approx(want) and set(RUDE) <= set(want)
    monkeypatch.setattr(toxicity, "LEXICON_SIZE", 3)
    assert set(toxicity.learn_lexicon(rows)) == set(sorted(want, key=lambda e: (-want[e] * math.log1p(counts[1][e]), e))[:3])


def test_calibration_never_turns_the_order(make_docs, spark):
    """Isotonic: of two documents the one that the trees rank higher never scores lower."""
    docs, labels = labelled(600)
    scored = toxicity.toxicity(make_docs(docs), spark.createDataFrame(labels, SCHEMA))
    by_row = sorted((r["score"], r["predicted"]) for r in scored.collect())
    assert [p for _, p in by_row] == sorted(p for _, p in by_row)
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(make_docs(docs[::-1]), spark.createDataFrame(labels[::-1], SCHEMA)).collect()}
    assert again == pytest.approx({r["doc_id"]: r["score"] for r in scored.collect()})
