"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.workers import group_arrow, map_arrow
from lumenshelf.llm.common import MAX_BROADCAST_BYTES, cut, given_back, id_key, join_groups, map_rows, set_apart, sized

#: Documents with a declared language from which the text model is fitted, chosen by a hash of the id
#: (expected number; the bound on what training reads, whatever the size of the corpus).
TRAIN_ROWS = 20_000
#: Documents of each language that are read at least, or all where there are fewer: a rare one must not
#: depend on the size of the corpus. Together at most TRAIN_ROWS + MAX_LANGUAGES * LANGUAGE_ROWS.
LANGUAGE_ROWS = 1_000
#: Buckets of hashed letter trigrams, and the languages that the model's table has room for: more than there
#: are two-letter tags. The table holds those that occur, the most declared ones (256 take 67 MB). Texts of any further language have no column of their own:
#: they are named as the likeliest language of the table, or ``und`` where none explains them, and their
#: declared tag counts as evidence like any other.
BUCKET_BITS, MAX_LANGUAGES = 16, 256
#: Weight of one trigram: neighbours overlap in two letters of three.
TEXT_WEIGHT = 1 / 3
#: Prior of text that is no known language, and rows that a smoothed prior counts for.
UNKNOWN_PRIOR, SMOOTHING = 1e-4, 20.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    return np.array([chr(c).isalpha() for c in range(0xD800)] + [False] * 0x800 + [chr(c).isalpha() for c in range(0xE000, 0x10000)])


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of a text's letter trigrams; each run of other characters is one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    is_letter = letters()[np.minimum(points, 0xFFFF)] & (points < 0x10000) | (points >= 0x20000)
    points = np.where(is_letter, points, 32)
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = (points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1]) * np.uint32(0x85EBCA6B) ^ points[2:]
    return (mixed * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def primary(declared: Column) -> Column:
    """The primary subtag of a declared language, lower case; null if there is none."""
    tag = F.regexp_extract(F.lower(F.trim(declared)), "^([a-z]{2,8})", 1)
    return F.when(tag != "", tag)


class TextModel:
    """Smoothed log-probabilities of trigram buckets per language, and of no language: uniform."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        total = counts.sum(axis=1, keepdims=True)
        size = counts.shape[1]
        known = np.log((counts + 0.5) / (total + 0.5 * size))
        self.languages = [*languages, UNKNOWN]
        self.table = np.ascontiguousarray(np.vstack([known, np.full((1, size), -log(size))]).T.astype(np.float32))

    def evidence(self, text: str | None) -> tuple[np.ndarray, int]:
        """Weighted log-likelihood per language, and the number of trigrams."""
        found = trigrams(text)
        sums = np.zeros(self.table.shape[1])
        for at in range(0, len(found), 1 << 16):
            sums += self.table[found[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return sums * TEXT_WEIGHT, len(found)


def fit_text_model(rows: DataFrame, train_rows: int = TRAIN_ROWS, max_languages: int = MAX_LANGUAGES) -> TextModel:
    """Fit on rows (_id, _text, _declared). Counts come back as one row per language and bucket: at
    most max_languages x 2^BUCKET_BITS, whatever the input.

    Each language is sampled by itself: its share of train_rows, LANGUAGE_ROWS at least, or all its
    rows (expected numbers). A tag without any trigram is no language of the model.
    """
    declared = rows.where(F.col("_declared").isNotNull())
    sizes = declared.groupBy("_declared").count()
    total = sizes.agg(F.sum("count")).first()[0] or 1
    sizes = {r["_declared"]: r["count"] for r in sizes.orderBy(F.desc("count"), "_declared").limit(max_languages).collect()}
    languages = sorted(sizes)
    limits = {x: int(min(1.0, max(train_rows / total, LANGUAGE_ROWS / n)) * (1 << 20)) + 1 for x, n in sizes.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("_declared")) if limits else F.lit(0)
    # Rows without an id are told apart by their text.
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("long"), F.xxhash64("_text")), "_declared"), F.lit(1 << 20))
    sample = declared.where(F.col("_declared").isin(languages) & (draw < limit))

    def count(batches):
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for language, text in zip(*[c.to_pylist() for c in batch.columns]):
                found = np.bincount(trigrams(text), minlength=1 << BUCKET_BITS)
                sums[language] = sums[language] + found if language in sums else found
            for language, found in sums.items():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at), pa.array(found[at])], ["language", "bucket", "n"])

    found = map_arrow(sample.select("_declared", "_text"), count, "language string, bucket long, n long")
    table, place = np.zeros((len(languages), 1 << BUCKET_BITS)), {x: k for k, x in enumerate(languages)}

    def packed(rows: pa.Table) -> pa.Table:
        counts = np.zeros(1 << BUCKET_BITS)
        counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        return pa.table({"language": rows["language"][:1], "counts": pa.array([counts.tobytes()])})

    # One row of counts per language comes back.
    for r in group_arrow(found.groupBy("language", "bucket").agg(F.sum("n").alias("n")), ["language"], packed, "language string, counts binary").collect():
        table[place[r["language"]]] = np.frombuffer(r["counts"])
    learned = table.any(axis=1)
    return TextModel([x for x, ok in zip(languages, learned) if ok], table[learned])


def score_texts(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows with evidence (array), best (place of the likeliest language) and n_grams, and without the text."""

    def start():
        def one(*values):
            *kept, text = values
            evidence, n = model.evidence(text)
            # Of equals the unknown language, which is last, wins.
            best = len(evidence) - 1 - int(np.argmax(evidence[::-1])) if n else len(evidence) - 1
            return *kept, signed_hash(text), evidence.tolist(), best, n

        return one

    return map_rows(rows, start, "_id long, _declared string, _host string, _domain string, _suffix string, _hash long, evidence array<double>, best int, n_grams long", ["_id", "_declared", "_host", "_domain", "_suffix", "_text"])


def signed_hash(text: str | None) -> int:
    """What Spark's xxhash64 gives for the text (null as empty)."""
    value = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def counts_by_language(counts: DataFrame, key: str, n: int) -> DataFrame:
    """Per value of key: n (rows) and by (array: rows per likeliest language)."""
    by = F.array(*[F.sum(F.when(F.col("best") == k, F.col("rows")).otherwise(F.lit(0))).cast("double") for k in range(n)])
    return counts.groupBy(key).agg(F.sum("rows").alias("n"), by.alias("by"))


def fuse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, domain: Column | None = None, suffix: Column | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The language of each row: id, language, confidence, text_language, declared, kept, n_grams and
    the keys _hash, _declared, _host.

    The posterior of a language is the product of the text's likelihood, P(declared | language),
    P(suffix | language) and the prior of the language on the host. The conditional tables and the
    priors are counts of all rows, grouped by the value and the language likeliest by text; the host
    prior is smoothed towards its domain's, and that towards the whole corpus'. ``und`` stands for text
    that no known language explains, or explains no better than chance (ties go to it); such rows, and
    rows without letters, are not kept.
    Null texts count as empty; a null declared language, host, domain or suffix is no evidence.
    Without any declared language there is no model, and all rows with letters are kept, as ``und``.
    """
    nothing = F.lit(None).cast("string")
    pick = lambda c: nothing if c is None else c.cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), primary(pick(declared)).alias("_declared"), pick(host).alias("_host"), pick(domain).alias("_domain"), pick(suffix).alias("_suffix"), F.col(text_col).alias("_text"))
    model = fit_text_model(rows, train_rows)
    n = len(model.languages)
    scored = cut(score_texts(rows, model))
    counts = cut(scored.where("n_grams > 0").groupBy("_declared", "_host", "_domain", "_suffix", "best").agg(F.count(F.lit(1)).alias("rows")))

    overall = np.zeros(n)
    for r in counts.groupBy("best").agg(F.sum("rows").alias("rows")).collect():
        overall[r["best"]] = r["rows"]
    known = overall[:-1] + 1.0
    overall_prior = [*(known / known.sum() * (1 - UNKNOWN_PRIOR)).tolist(), UNKNOWN_PRIOR]
    corpus = F.array(*[F.lit(float(x)) for x in overall_prior])
    per_language = F.array(*[F.lit(float(x)) for x in overall + SMOOTHING])

    def smoothed(by: Column, total: Column, towards: Column) -> Column:
        return F.zip_with(by, towards, lambda c, p: (c + SMOOTHING * p) / (total + SMOOTHING))

    domains = counts_by_language(counts.where("_domain IS NOT NULL"), "_domain", n)
    domains = domains.select("_domain", smoothed(F.col("by"), F.col("n"), corpus).alias("domain_prior"))
    hosts = counts_by_language(counts.where("_host IS NOT NULL"), "_host", n)
    of = counts.where("_host IS NOT NULL").groupBy("_host").agg(F.min("_domain").alias("_domain"))
    hosts = hosts.join(of, "_host").join(domains, "_domain", "left")
    hosts = hosts.select(F.col("_host").alias("_hk"), F.col("n").alias("host_rows"), smoothed(F.col("by"), F.col("n"), F.coalesce("domain_prior", corpus)).alias("prior"))

    total = scored.count()

    def with_likelihood(rows: DataFrame, key: str) -> DataFrame:
        """rows with log P(value | language) for the value of the key; for ``und`` the overall rate of the value.
        A table of many values is joined as groups, since each value carries a number per language."""
        found = counts_by_language(counts.where(F.col(key).isNotNull()), key, n)
        rate = F.col("n") / F.lit(float(max(1.0, overall.sum())))
        each = F.zip_with(F.col("by"), per_language, lambda c, t: F.log((c + SMOOTHING * rate) / t))
        out = F.concat(F.slice(each, 1, n - 1), F.array(F.log(rate)))
        table, small = sized(found.select(F.col(key).alias("_lk"), F.col("n").alias(f"{key}_rows"), out.alias(f"{key}_like")), MAX_BROADCAST_BYTES // (8 * n + 64))
        rows = rows.withColumn("_lk", F.coalesce(key, F.lit("")))
        return (rows.join(table, "_lk", "left") if small else join_groups(rows, table, "_lk", f"{key}_rows", total, F.col("_id"))).drop("_lk")

    rows = with_likelihood(with_likelihood(scored, "_declared"), "_suffix")
    rows = rows.withColumn("_hk", F.coalesce("_host", F.lit("")))
    rows = join_groups(rows, hosts, "_hk", "host_rows", total, F.col("_id"))
    none = F.array(*[F.lit(0.0)] * n)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = F.transform(F.coalesce("prior", corpus), lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    logs = add(add(F.col("evidence"), logs), add(F.coalesce("_declared_like", none), F.coalesce("_suffix_like", none)))
    rows = rows.withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    names = F.array(*[F.lit(x) for x in model.languages])
    weight = F.aggregate(F.transform("_logs", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumns({"language": F.when((F.col("n_grams") > 0) & (F.element_at("_logs", n) < F.col("_top")), F.element_at(names, F.array_position("_logs", F.col("_top")).cast("int"))).otherwise(F.lit(UNKNOWN)), "confidence": F.when(F.col("n_grams") > 0, 1 / weight).otherwise(F.lit(0.0))})
    fits = (F.col("language") != UNKNOWN) | F.lit(n == 1)
    return rows.select(F.col("_id").alias(id_col), "language", "confidence", F.element_at(names, F.col("best") + 1).alias("text_language"), F.col("_declared").alias("declared"), (fits & (F.col("n_grams") > 0)).alias("kept"), "n_grams", "_hash", "_declared", "_host")


def identify_documents(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``fuse`` on documents: lang is the declared language, source the host. Documents have no address, so
    there is no suffix and no domain above the host; identify_pages has all of the evidence.

    Null languages and sources are no evidence, null texts are empty, and repeated rows come back as often.
    """
    return fuse(docs, declared=F.col("lang"), host=F.col("source"), train_rows=train_rows)


def keep_identified(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents, all columns, whose language is known. The few that are rejected leave by an
    anti join on id, text hash, language and source."""
    base, names = set_apart(docs)
    doc, text, lang, source = (names[c] for c in ("doc_id", "text", "lang", "source"))
    keys = {"_k1": id_key(doc), "_k2": F.xxhash64(F.coalesce(text, F.lit(""))), "_k3": F.coalesce(primary(F.col(lang)), F.lit("")), "_k4": F.coalesce(source, F.lit(""))}
    out = identify_documents(docs, train_rows).where("NOT kept")
    drops = out.select(id_key("doc_id").alias("_k1"), F.col("_hash").alias("_k2"), F.coalesce("_declared", F.lit("")).alias("_k3"), F.coalesce("_host", F.lit("")).alias("_k4")).distinct()
    return given_back(base.withColumns(keys).join(sized(drops)[0], [*keys], "left_anti"), names)


def identify_pages(pages: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``fuse`` on web pages: the main text, the language that the html element declares, the address'
    host with its registered domain above it, and as suffix the top-level domain with a first path
    segment of two letters, if there is one."""
    from lumenshelf.llm import html_extract

    texts = html_extract.extract(pages)
    marks = pages.select("page_id", "url", F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("_lang"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    segment = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://[^/]+/([A-Za-z]{2})(?:/|$)", 1))
    blank = lambda c: F.when(c != "", c)
    keyed = texts.withColumnsRenamed({"text": "_main"}).select("page_id", "url", "_main").join(marks.dropDuplicates(["page_id", "url"]), ["page_id", "url"], "left")
    return fuse(
        keyed, "page_id", "_main", declared=blank(F.col("_lang")), host=blank(host), domain=blank(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")),
        suffix=blank(F.concat_ws("/", blank(F.element_at(labels, -1)), blank(segment))), train_rows=train_rows,
    )
