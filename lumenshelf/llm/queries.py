"""The registered queries of the corpus operators: op1 to op13."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenshelf.llm import bpe, curriculum, exact_dedup, html_extract, language_id, ranked_search, repeats, secrets, simhash, token_files, toxicity, vector_codes, webp
from lumenshelf.llm.common import id_key, table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    narrow = docs.select("doc_id", "source", curriculum.words().alias("size"))
    plan = curriculum.mix_plan(docs)
    keyed = narrow.withColumns({"_idk": id_key(), "_sk": curriculum.source_key("source")})
    rows = keyed.join(plan, ["_sk", "_idk", "size"])
    first = F.when(F.col("copies") > 0, curriculum.position(F.lit(0)))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round(first, 9).alias("first_position")).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def vocabulary_path() -> str:
    """The installed vocabulary file; workers open it by the same path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents")).drop("_hash", "_declared", "_host")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID with all of its evidence, on the web pages."""
    return language_id.identify_pages(table(spark, sf_dir, "pages")).drop("_hash", "_declared", "_host")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_repeats": op5_repeats,
    "op6_bpe": op6_bpe,
    "op7_webp": op7_webp,
    "op8_simhash": op8_simhash,
    "op9_secrets": op9_secrets,
    "op10_language_id": op10_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_files": op12_token_files,
    "op13_vector_codes": op13_vector_codes,
    "pages_language_id": pages_language_id,
}

WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"


def fill(k: int) -> str:
    """One round that fills the gap left by the rounds before."""
    before = "sum(CASE WHEN fits THEN whole ELSE 0 END) OVER (PARTITION BY source ORDER BY md5(idk), idk, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""gap{k} AS (SELECT *, rest - sum(CASE WHEN extra THEN whole ELSE 0 END) OVER (PARTITION BY source) AS gap FROM fill{k - 1}),
fits{k} AS (SELECT *, NOT extra AND whole > 0 AND whole <= gap AS fits FROM gap{k}),
fill{k} AS (SELECT * EXCLUDE (gap, fits, extra), extra OR (fits AND coalesce({before}, 0) + whole <= gap) AS extra FROM fits{k})"""


MIX_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') AS idk, {WORDS} AS size FROM documents),
sizes AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS pick FROM d GROUP BY source),
caps AS (SELECT *, CAST(pick + 1 AS DOUBLE) AS w, 3e0 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM sizes),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER ahead, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER ahead, 0)) AS level FROM caps WINDOW ahead AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap < w * level AS is_capped FROM levels),
targets AS (SELECT source, source_size, pick, CASE WHEN is_capped THEN cap ELSE least(w * (total - coalesce(sum(cap) FILTER (WHERE is_capped) OVER (), 0)) / (sum(w) OVER () - coalesce(sum(w) FILTER (WHERE is_capped) OVER (), 0)), cap) END AS target FROM capped),
places AS (SELECT source, idk, size, size * count(*) AS whole FROM d GROUP BY 1, 2, 3),
placed AS (SELECT p.*, t.source_size, t.pick, t.target, CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 3) ELSE 0 END AS passes,
 coalesce(sum(whole) OVER (PARTITION BY p.source ORDER BY md5(idk), idk, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM places p JOIN targets t ON t.source IS NOT DISTINCT FROM p.source),
rests AS (SELECT *, target - passes * source_size AS rest FROM placed),
fill0 AS (SELECT *, whole > 0 AND before + whole <= rest AS extra FROM rests),
{fill(1)},
{fill(2)},
plan AS (SELECT *, CAST(passes AS INT) + CAST(extra AS INT) AS copies FROM fill2),
shares AS (SELECT *, CASE WHEN target > 0 THEN least(greatest((before + size / 2e0) / target, 0e0), 1e0) ELSE 0e0 END AS share FROM plan),
wants AS (SELECT *, share * (pick + 1) AS want FROM shares)
SELECT d.doc_id, d.size, CAST(p.source_size AS BIGINT) AS source_size, p.target, CAST(p.copies * d.size AS BIGINT) AS taken, p.copies,
 CASE WHEN p.copies > 0 THEN round(CASE WHEN want <= 0 THEN 0e0 WHEN pick = 0 THEN 2 * want / (1.5e0 + sqrt(greatest(2.25e0 - 2 * want, 0e0))) WHEN pick = 1 THEN 2 * want / (2e0 + sqrt(4e0)) ELSE 2 * want / (2e0 + sqrt(4e0 + 4 * want)) END, 9) END AS first_position
FROM d JOIN wants p ON p.source IS NOT DISTINCT FROM d.source AND p.idk = d.idk AND p.size = d.size"""

EXACT_SQL = """WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)"""

TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED_SQL = f"""WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {TERMS} AS terms FROM documents),
p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) GROUP BY doc, term),
totals AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM d WHERE len(terms) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2e0 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, totals GROUP BY term, n_docs),
m AS (SELECT doc, doc_id, CAST(10 + (90 * len(terms) * n_docs) // n_terms AS BIGINT) AS m FROM d, totals WHERE len(terms) > 0),
items AS (SELECT item_id, text, unnest(list_distinct({TERMS})) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
scores AS (SELECT i.item_id, i.text, doc_id, doc, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * m.m))) AS score
 FROM items i JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc) GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""

#: The other operators need byte, tree or model work that SQL lacks; their tests hold them to brute force.
ORACLES: dict[str, str] = {"op3_exact_dedup": EXACT_SQL, "op4_mix_sources": MIX_SQL, "op11_ranked_search": RANKED_SQL}
