"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.workers import map_arrow
from lumenshelf.llm.common import cut, id_key, map_rows, sized

#: Labelled rows that learning reads, chosen by a hash of the id (expected number).
TRAIN_ROWS = 20_000
#: Folds of crc32(id as text): 0 is never learned from, 1 calibrates, the others fit.
FOLDS, CALIBRATION_FOLD = 5, 1
#: Entries of the lexicon, which is a part of the model as the trees are: those of the most weight. Least toxic
#: documents and log-odds of an entry.
LEXICON_SIZE, LEAST_DOCUMENTS, LEAST_WEIGHT = 3000, 4, 2.0
#: Beginnings of longer words that may be entries of their own, in letters.
STEMS = (4, 5, 6, 7)
TREES, DEPTH = 20, 3
#: Share of the uncalibrated score in the final one; it only orders rows that calibration ties.
ORDER_SHARE = 0.002

WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"(?<!\S)[^\W\d_]+[0-9@$!|*]+[^\W\d_]+\S*|(?<!\S)[^\W\d_](?:[.\-_*][^\W\d_]){2,}(?!\S)")
#: Characters that stand for letters, and second-person words of four languages.
DISGUISE = str.maketrans("0134578@$!|", "oieastbasii", "*.-_")
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner ihr euch euer eure"
    " tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros vuestro vuestra".split()
)
NEAR_WORDS, CACHED_WORDS = 4, 200_000
FEATURES = ("words", "weight_per_word", "hits", "strongest", "hits_per_word", "near_you", "you_per_word", "capitals", "shouted", "marks", "repeated_marks", "disguised", "disguised_hits", "stretched")


def entries(word: str) -> list[str]:
    """What of a word may stand in the lexicon: itself and its beginnings."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


class Features:
    """Dense features of a text under a lexicon (entry to log-odds)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.cache = lexicon, {}

    def weight(self, word: str) -> float:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            got = self.cache[word] = max([0.0, *[self.lexicon.get(e, 0.0) for e in entries(word)]])
        return got

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        lower = text.lower()
        words = WORD.findall(lower)
        weight = self.cache.get
        weights = [self.weight(w) if (g := weight(w)) is None else g for w in words]
        hits = [i for i, w in enumerate(weights) if w > 0]
        strength, you, near = sum(weights), [], 0
        if not SECOND_PERSON.isdisjoint(words):
            you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
            k = 0
            for i in hits:
                while k < len(you) and you[k] < i - NEAR_WORDS:
                    k += 1
                near += k < len(you) and you[k] <= i + NEAR_WORDS
        disguised = DISGUISED.findall(lower) if lower else []
        plain = [w for d in disguised for w in WORD.findall(d.translate(DISGUISE))]
        hidden = [x for w in plain if (x := self.weight(w)) > 0]
        n, chars = max(1, len(words)), max(1, len(text))
        letters = max(1, sum(map(len, words)))
        capitals = len(CAPITALS.findall(text))
        marks = text.count("!") + text.count("?")
        return [
            log1p(len(words)), (strength + sum(hidden)) / n, log1p(len(hits) + len(hidden)), max([0.0, *(weights[i] for i in hits), *hidden]), (len(hits) + len(hidden)) / n,
            log1p(near), len(you) / n, capitals / letters, len(SHOUTED.findall(text)) / n, marks / chars, len(REPEATED.findall(text)) / n,
            len(disguised) / n, log1p(len(hidden)), len(STRETCHED.findall(lower)) / n,
        ]


CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
REPEATED = re.compile(r"[!?]{2,}")
STRETCHED = re.compile(r"([^\W\d_])\1\1")


def document_counts(rows: DataFrame) -> DataFrame:
    """entry, toxic, clean: in how many toxic and other rows (columns text and toxic) each entry occurs."""

    def run(batches):
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for e in {e for w in set(WORD.findall((text or "").lower())) for e in entries(w)}:
                    sums.setdefault(e, [0, 0])[1 - toxic] += 1
            counts = np.array(list(sums.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["entry", "toxic", "clean"])

    return map_arrow(rows.select("text", "toxic"), run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and beginnings with the greatest log-odds of toxic documents, from rows (text, toxic).

    Entries of LEAST_DOCUMENTS toxic rows and LEAST_WEIGHT log-odds are weighed in Spark; the model takes the
    LEXICON_SIZE of them with the most weight, by log-odds and frequency.
    """
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (positive + 1)) - F.log((F.col("clean") + 0.5) / (negative + 1))
    weighed = document_counts(rows).where(F.col("toxic") >= LEAST_DOCUMENTS).select("entry", "toxic", odds.alias("odds")).where(F.col("odds") >= LEAST_WEIGHT)
    best = weighed.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "entry").limit(LEXICON_SIZE)
    return {r["entry"]: r["odds"] for r in best.collect()}


def features(rows: DataFrame, lexicon: dict[str, float], keep: str) -> DataFrame:
    """keep's columns (all long) and the features of column text."""
    names = keep.split()

    def start():
        make = Features(lexicon)
        return lambda *values: (*values[:-1], make(values[-1]))

    return map_rows(rows, start, ", ".join(f"{n} long" for n in names) + ", features array<double>", [*names, "text"])


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; a null id counts as the empty text."""
    return F.crc32(id_key(id_col)) % FOLDS


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score each row: id, held_out, score (0 to 1), predicted.

    Learning reads a hash-chosen part of the labelled rows outside fold 0, about ``train_rows``: trees
    and lexicon from folds 2 on, calibration from fold 1. Ids with contradicting labels count as toxic;
    null labels and ids are not learned from. If the rows lack one of the classes, every score is
    their share of toxic rows (0.5 without any). Null and empty texts are scored like any other.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("long").alias("toxic"))
    marks = marks.where(fold(id_col) != 0)
    share = min(1.0, train_rows / max(1, marks.count()))
    chosen, _ = sized(marks.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)) + 1), 2 * train_rows)
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen.withColumnRenamed(id_col, "_id"), "_id")
    known = cut(known.select("text", "toxic", (fold("_id") == CALIBRATION_FOLD).cast("long").alias("calibrate")))
    fit = known.where("calibrate = 0")
    classes = {(r["toxic"], r["calibrate"]): r["count"] for r in known.groupBy("toxic", "calibrate").count().collect()}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held = (fold("id") == 0).alias("held_out")
    if not all(classes.get((y, 0)) for y in (0, 1)):
        positive, total = sum(n for (y, _), n in classes.items() if y), sum(classes.values())
        scored = rows.withColumn("score", F.lit(positive / total if total else 0.5).cast("double"))
        return scored.select(F.col("id").alias(id_col), held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    lexicon = learn_lexicon(fit)
    vector = array_to_vector("features").alias("features")
    learn = cut(features(known, lexicon, "toxic calibrate")).select("toxic", "calibrate", vector)
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, checkpointInterval=-1).fit(learn.where("calibrate = 0"))
    raw = F.element_at(vector_to_array("probability"), 2)
    # With no rows to calibrate on, the rows that fitted the trees stand in.
    held_back = learn.where("calibrate = 1") if sum(n for (_, c), n in classes.items() if c) else learn
    curve = IsotonicRegression(labelCol="toxic", featuresCol="raw").fit(trees.transform(held_back).select(F.col("toxic").cast("double"), raw.alias("raw")))
    scored = trees.transform(features(rows, lexicon, "id").select("id", vector)).select("id", raw.alias("raw"))
    scored = curve.transform(scored)
    score = F.least(F.greatest(F.col("prediction") * (1 - ORDER_SHARE) + F.col("raw") * ORDER_SHARE, F.lit(0.0)), F.lit(1.0))
    scored = scored.withColumn("score", score)
    return scored.select(F.col("id").alias(id_col), held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
