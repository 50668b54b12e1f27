"""Queries on text search, vectors, fusion and near duplicates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions import text as T
from lumenshelf.functions.storage import settled, shared_folder
from lumenshelf.operators import ann, search, snapshots, textindex, vectors
from lumenshelf.registry import query
from lumenshelf.sources.fixtures import Catalog

RUNS = r"[\p{L}\p{N}]+"


def sql_plain(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{RUNS}')"


def sql_name_tokens(column: str) -> str:
    parts = r"string_split(regexp_replace(regexp_replace(regexp_replace(r, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})([0-9])', '\1 \2', 'g'), '([0-9])(\p{L})', '\1 \2', 'g'), ' ')"
    return f"list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all({column}, '{RUNS}'), lambda r: list_concat([r], {parts}))), lambda t: lower(t)), lambda t: strlen(t) >= 2))"


FOLDER = "array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/')"
ROWS = f"""WITH search_rows AS (SELECT a.id, a.filename AS name, {sql_plain('a.filename')} AS filename, {sql_name_tokens('a.filename')} AS tokens, {sql_plain("coalesce(t.tags, '')")} AS tags,
 {sql_plain("coalesce(n.body, '')")} AS note, {sql_name_tokens(FOLDER)} AS folder, {sql_plain("coalesce(d.text, '')")} AS body FROM asset a
 LEFT JOIN (SELECT x.asset_id, string_agg(t.name, ' ' ORDER BY t.name) AS tags FROM asset_tag x JOIN tag t USING (tag_id) WHERE x.state = 'confirmed' GROUP BY 1) t ON t.asset_id = a.id
 LEFT JOIN asset_note n ON n.asset_id = a.id LEFT JOIN documents d ON d.doc_id * 2 = a.id)"""


def sql_matched(text: str, columns=tuple(search.WEIGHTS)) -> str:
    groups = T.query_groups(text)
    one = lambda c, t: f"len(list_filter({c}, lambda x: starts_with(x, '{t}'))) > 0"
    return " AND ".join("(" + " OR ".join(one(c, t) for c in columns for t in g) + ")" for g in groups)


def sql_ranked(text: str) -> str:
    """CTEs up to hits(id, name, rank, tier) of the word matches."""
    terms = sorted({t for g in T.query_groups(text) for t in g})
    tf = [" + ".join(f"len(list_filter({c}, lambda x: starts_with(x, '{t}'))) * {w}e0" for c, w in search.WEIGHTS.items()) for t in terms]
    n = range(len(terms))
    length = " + ".join(f"len({c})" for c in search.WEIGHTS)
    part = lambda k: f"greatest(ln((n - df{k} + 0.5e0) / (df{k} + 0.5e0)), 1e-6) * tf{k} * 2.2e0 / (tf{k} + 1.2e0 * (0.25e0 + 0.75e0 * length / mean))"
    return f"""{ROWS}, scored AS (SELECT id, name, {', '.join(f'{e} AS tf{k}' for k, e in enumerate(tf))}, {length} AS length, {sql_matched(text)} AS hit, {sql_matched(text, search.AUTHORED)} AS authored FROM search_rows),
 stats AS (SELECT count(*) AS n, avg(length) AS mean, {', '.join(f'count(*) FILTER (WHERE tf{k} > 0) AS df{k}' for k in n)} FROM scored),
 hits AS (SELECT id, name, -({' + '.join(map(part, n))}) AS rank, CASE WHEN authored THEN 0 ELSE 1 END AS tier FROM scored, stats WHERE hit)"""


TEXT = "src1 the"
query("tok_name", f"SELECT id, array_to_string(list_sort({sql_name_tokens('filename')}), ' ') AS tokens FROM asset")(lambda c: c.asset.select("id", F.array_join(F.sort_array(T.name_tokens(F.col("filename"))), " ").alias("tokens")))
query("tok_folder", f"SELECT id, array_to_string(list_sort({sql_name_tokens(FOLDER)}), ' ') AS tokens FROM asset")(lambda c: c.asset.select("id", F.array_join(F.sort_array(T.folder_tokens(F.col("path"))), " ").alias("tokens")))


@query("syn_expand", "SELECT unnest(['blade', 'katana', 'dagger', 'knife', 'machete', 'melee', 'sword']) AS term")
def syn_expand(c: Catalog) -> DataFrame:
    return c.spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in T.query_groups("Sword")[0]])).alias("term"))


query("fts_match", f"{ROWS} SELECT id FROM search_rows WHERE {sql_matched('ring promo')}")(lambda c: search.search_rows(c).where(search.matched(search.search_rows(c), T.query_groups("ring promo"))).select("id"))
query("fts_columns", f"{ROWS} SELECT id, len(filename) AS filename, len(tokens) AS tokens, len(tags) AS tags, len(note) AS note, len(folder) AS folder, len(body) AS body FROM search_rows")(lambda c: search.search_rows(c).select("id", *[F.size(x).cast("long").alias(x) for x in search.WEIGHTS]))
query("bm25_rank", f"{sql_ranked(TEXT)} SELECT id, round(rank, 6) AS rank FROM hits")(lambda c: search.ranked(search.search_rows(c), T.query_groups(TEXT)).select("id", F.round("rank", 6).alias("rank")))
query("tier_authored", f"{sql_ranked(TEXT)} SELECT id, tier FROM hits")(lambda c: search.ranked(search.search_rows(c), T.query_groups(TEXT)).select("id", "tier"))
query("trigram_substring", "SELECT id FROM asset WHERE contains(lower(filename), 'idge')")(lambda c: textindex.kept_index(c).snapshot().substring_hits("IDGE").select("id"))
query("substring_scan", "SELECT id FROM asset WHERE contains(lower(filename), 'idge')")(lambda c: search.substring_hits(c.asset.select("id", F.col("filename").alias("name")), "IDGE").select("id"))
query("short_text", "SELECT id FROM (SELECT * FROM asset ORDER BY id DESC LIMIT 4096) WHERE contains(lower(filename), 'g_')")(lambda c: search.short_hits(c.asset, "g_").select("id"))
SUBSTRING = "contains(lower(name), 'idge')"
query("text_where", f"{ROWS} SELECT id FROM search_rows WHERE ({sql_matched('idge')}) OR {SUBSTRING}")(lambda c: search.text_filter(c, "idge"))


@query("search_relevance_sort", f"{sql_ranked(TEXT)} SELECT id, tier, round(rank, 6) AS rank FROM hits ORDER BY tier, round(hits.rank, 6), length(name), name, id LIMIT 40")
def search_relevance_sort(c: Catalog) -> DataFrame:
    """From the kept index: ranges of terms and grams, no body of a document."""
    return textindex.kept_index(c).snapshot().search(TEXT, 40).select("id", "tier", F.round("rank", 6).alias("rank"))




@query("fts_segments", f"{sql_ranked(TEXT)} SELECT id, tier, round(rank, 6) AS rank FROM hits")
def fts_segments(c: Catalog) -> DataFrame:
    """Ranks after batches of edits (rows that were not there, rows of another note, rows that had to go) are those of
    the catalogue as it is now, which the SQL reads whole."""
    rows, index = search.search_rows(c), textindex.TextIndex(c.spark, f"{shared_folder(c.spark)}/text-index-{uuid.uuid4().hex}")
    stale = F.when(F.col("id") % 10 == 5, F.array(F.lit("the"), F.lit("stale"))).otherwise(F.col("note"))
    surplus = rows.where("id % 50 = 7").withColumn("id", -F.col("id"))
    index.build(rows.where("id % 10 <> 3").withColumn("note", stale).unionByName(surplus))
    index.apply(rows.where("id % 10 = 5"), surplus.select("id"))
    found = index.apply(rows.where("id % 10 = 3"), surplus.select("id").limit(0))
    return found.hits(TEXT).where("tier < 2").select("id", "tier", F.round("rank", 6).alias("rank"))


query("set_tier_append", f"{sql_ranked('ring')}, subs AS (SELECT id, name FROM search_rows WHERE contains(lower(name), 'ring') AND id NOT IN (SELECT id FROM hits)) SELECT id, tier FROM hits UNION ALL SELECT id, 2 FROM subs")(lambda c: search.hits(c, "ring").select("id", "tier"))
query("keyset_relevance", f"{sql_ranked(TEXT)} SELECT id FROM hits WHERE tier > 1 OR (tier = 1 AND rank > -9.5)")(lambda c: search.ranked(search.search_rows(c), T.query_groups(TEXT)).where(search.after_relevance(1, -9.5, "a", 3)).select("id"))
query("fts_maintain", f"{ROWS} SELECT id, array_to_string(tags, ' ') AS tags FROM search_rows WHERE len(tags) > 0")(lambda c: search.search_rows(c).where(F.size("tags") > 0).select("id", F.array_join("tags", " ").alias("tags")))

# Vectors


def spaces(c: Catalog, n: int = 1) -> DataFrame:
    return c.base("embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("space-"), (F.col("label") % n).cast("string")).alias("space_id"), F.col("embedding").alias("vec"))


def sql_spaces(n: int = 1) -> str:
    return f"WITH v AS (SELECT vec_id AS id, concat('space-', label % {n}) AS space_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


SCORE = "round(list_cosine_similarity(v.vec, s.vec), 6) AS score"
NEAREST = f"{sql_spaces(3)}, s AS (SELECT * FROM v WHERE id = 7) SELECT v.id, {SCORE} FROM v, s WHERE v.id <> 7 AND v.space_id = s.space_id ORDER BY score DESC, v.id LIMIT 20"
query("cosine", f"{sql_spaces()}, s AS (SELECT * FROM v WHERE id = 3) SELECT v.id, {SCORE} FROM v, s")(lambda c: spaces(c).select("id", F.round(vectors.cosine(F.col("vec"), vectors.literal(spaces(c).where("id = 3").first()["vec"])), 6).alias("score")))
query("knn_by_asset", NEAREST)(lambda c: vectors.nearest_to_asset(spaces(c, 3), 7, 20))


@query("knn_by_vector", f"{sql_spaces()}, s AS (SELECT * FROM v WHERE id = 11) SELECT v.id, {SCORE} FROM v, s ORDER BY score DESC, v.id LIMIT 15")
def knn_by_vector(c: Catalog) -> DataFrame:
    rows = spaces(c)
    wanted = rows.where("id = 11").first()["vec"]
    return vectors.nearest(rows, vectors.checked_vector(rows, "space-0", wanted), 15, "space-0")


query("topk_vector", f"{sql_spaces()}, s AS (SELECT * FROM v WHERE id = 5) SELECT v.id, {SCORE} FROM v, s WHERE v.id <> 5 ORDER BY score DESC, v.id LIMIT 64")(lambda c: vectors.nearest_to_asset(spaces(c), 5, 64))
ANN = f"""{sql_spaces()} SELECT qid, id, score, CAST(rank AS INT) AS rank FROM (SELECT q.id AS qid, v.id, round(list_cosine_similarity(q.vec, v.vec), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vec, v.vec), 6) DESC, v.id) AS rank FROM v JOIN v q ON q.id % 50 = 0 AND q.id <> v.id) WHERE rank <= 10"""


@query("knn_ann", ANN)
def knn_ann(c: Catalog) -> DataFrame:
    """Every query's neighbours through the index, each search carried on until no other cell can hold a better row."""
    found = ann.fresh_index(c.spark).build(spaces(c))
    return found.search(spaces(c).where("id % 50 = 0").withColumnRenamed("id", "qid"), 10, exact=True)


@query("knn_ivf_recall", f"{sql_spaces()} SELECT count(*) AS indexed, count(*) FILTER (WHERE id % 50 = 0) AS asked, true AS reached FROM v")
def knn_ivf_recall(c: Catalog) -> DataFrame:
    """Whether searches that read only the nearest cells find nine of ten neighbours, over all asked rows."""
    found = ann.fresh_index(c.spark).build(spaces(c))
    asked = spaces(c).where("id % 50 = 0").withColumnRenamed("id", "qid")
    got = found.search(asked, 10, found.tuned(10)).select("qid", "id")
    truth = vectors.nearest_by_blocks(spaces(c), asked, 10).select("qid", "id")
    share = truth.join(got.withColumn("hit", F.lit(1)), ["qid", "id"], "left").agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("reached"))
    indexed = found.rows().where("cell >= 0").agg(F.count(F.lit(1)).alias("indexed"))
    return indexed.join(asked.agg(F.count(F.lit(1)).alias("asked"))).join(share)


query("vector_spaces", f"{sql_spaces(3)} SELECT space_id, CAST(len(vec) AS INT) AS dim, count(*) AS n FROM v WHERE vec IS NOT NULL GROUP BY 1, 2")(lambda c: vectors.spaces_of(spaces(c, 3)))


@query("ann_overlay", f"{sql_spaces()} SELECT id, space_id FROM v WHERE id % 10 <> 3 OR id % 20 = 3 UNION ALL SELECT id + 1000000, space_id FROM v WHERE id % 100 = 0")
def ann_overlay(c: Catalog) -> DataFrame:
    """Deletions, upserts and new rows as generations of an index, some of which are written anew on the way."""
    base, index = spaces(c), ann.fresh_index(c.spark)
    index.build(base)
    for rows, op in ((base.where("id % 10 = 3"), "delete"), (base.where("id % 20 = 3"), "upsert"), (base.where("id % 100 = 0").withColumn("id", F.col("id") + 1000000), "upsert")):
        found = index.apply(rows.withColumn("op", F.lit(op)))
    return found.rows().select("id", "space_id")


@query("search_postings", f"{sql_ranked(TEXT)} SELECT id, tier, round(rank, 6) AS rank FROM hits")
def search_postings(c: Catalog) -> DataFrame:
    """The ranking read from an index on disk."""
    terms, lengths = search.postings(search.search_rows(c))
    folder = f"{shared_folder(c.spark)}/postings-{uuid.uuid4().hex}"
    search.write_in_order(terms, f"{folder}/terms", "term", "id")
    lengths.write.parquet(f"{folder}/lengths")
    read = c.spark.read.parquet
    return search.ranked_by_postings(read(f"{folder}/terms"), read(f"{folder}/lengths"), T.query_groups(TEXT)).select("id", "tier", F.round("rank", 6).alias("rank"))


@query("join_lateral_true", "SELECT 5 AS generation, d.id, d.seq FROM (SELECT 1 AS one) s LEFT JOIN (SELECT event_id AS id, event_id AS seq FROM events WHERE event_id > 5 ORDER BY seq DESC LIMIT 40) d ON TRUE")
def join_lateral_true(c: Catalog) -> DataFrame:
    journal = c.base("events").select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"))
    return vectors.delta_window(c.spark.range(1).select(F.lit(5).alias("generation")), journal, 40)


# Word hits of the registered text lead; those that have a vector seed the third list.
WORDS = f"""{sql_ranked(TEXT)}, v AS (SELECT vec_id AS id, concat('space-', label % 1) AS space_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
 words AS (SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY tier, round(hits.rank, 6), length(name), name, id) - 1 AS rank FROM hits) WHERE rank < 400)"""
SEEDS = "s AS (SELECT v.* FROM v JOIN words USING (id) WHERE words.rank < 24)"
SEEDED = "(SELECT v.id, max(round(list_cosine_similarity(v.vec, s.vec), 6)) AS score FROM v JOIN s USING (space_id) WHERE v.id NOT IN (SELECT id FROM words WHERE rank < 24) GROUP BY 1)"


def words(c: Catalog) -> DataFrame:
    """The first word hits from the kept index, written once for all that use them."""
    found = textindex.kept_index(c).snapshot().search(TEXT, vectors.LEXICAL_CAP)
    return settled(vectors.with_rank(found, *search.relevance()).select("id", "rank"))


query("seed_neighbours", f"{WORDS}, {SEEDS} SELECT id, score FROM {SEEDED} ORDER BY score DESC, id LIMIT 400")(lambda c: vectors.seeded(spaces(c), words(c).where("rank < 24")))
query("agg_best_neighbour", f"{WORDS}, {SEEDS} SELECT id, score FROM {SEEDED} WHERE score > 0.2 ORDER BY score DESC, id LIMIT 400")(lambda c: vectors.seeded(spaces(c), words(c).where("rank < 24")).where("score > 0.2"))


def lists(c: Catalog, mode: str, with_vector: bool = True) -> list[tuple[DataFrame, float]]:
    """The lists of a hybrid search for the registered text, with the vector of row 5 for the text's."""
    wanted = spaces(c).where("id = 5").first()["vec"] if with_vector else None
    return vectors.hybrid_lists(words(c), spaces(c), wanted, "space-0", mode)


LISTS = f"""{WORDS}, {SEEDS}, t AS (SELECT vec FROM v WHERE id = 5), near AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT v.id, round(list_cosine_similarity(v.vec, t.vec), 6) AS score FROM v, t ORDER BY score DESC, v.id LIMIT 400)),
 seeded AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT * FROM {SEEDED} ORDER BY score DESC, id LIMIT 400))"""
query("win_rrf_rank", f"{LISTS} SELECT id, CAST(rank AS INT) AS rank FROM near")(lambda c: lists(c, "hybrid")[1][0])


def sql_fused(*weights: float) -> str:
    parts = [f"SELECT id, {w}e0 / (60 + rank + 1) AS part FROM {t}" for w, t in zip(weights, ("words", "near", "seeded"))]
    return f"SELECT id, round(sum(part), 9) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY 1"


HYBRID, SEMANTIC = (sql_fused(*vectors.FUSION[m]) for m in ("hybrid", "semantic"))
query("agg_rrf", f"{LISTS} {HYBRID}")(lambda c: vectors.fused(lists(c, "hybrid")))


@query("rrf_hybrid", f"{LISTS} SELECT f.id, a.filename, f.score FROM ({SEMANTIC}) f JOIN asset a ON a.id = f.id ORDER BY score DESC, filename, f.id LIMIT 100")
def rrf_hybrid(c: Catalog) -> DataFrame:
    rows = vectors.fused(lists(c, "semantic")).join(c.asset.select("id", "filename"), "id")
    return rows.orderBy(F.desc("score"), "filename", "id").limit(100)


query("keyset_hybrid", f"{LISTS} SELECT * FROM ({HYBRID}) WHERE score < 0.01 OR (score = 0.01 AND id > 9) ORDER BY score DESC, id LIMIT 50")(lambda c: vectors.fused(lists(c, "hybrid")).where("score < 0.01 OR (score = 0.01 AND id > 9)").orderBy(F.desc("score"), "id").limit(50))
query("hybrid_fallback", f"{LISTS} {sql_fused(vectors.FUSION['hybrid'][0])}")(lambda c: vectors.fused(lists(c, "hybrid", False)))

LEAST = 0.4  # the fixture's vectors are less alike than the default threshold asks
PAIRS = f"{sql_spaces(3)}, pairs AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.space_id = y.space_id AND x.id < y.id AND list_cosine_similarity(x.vec, y.vec) >= {LEAST})"
query("join_theta_cosine", f"{PAIRS} SELECT a, b FROM pairs")(lambda c: vectors.close_pairs(spaces(c, 3), LEAST))
# Components by a recursive walk over the pairs.
NEAR = f"""{PAIRS.replace('WITH', 'WITH RECURSIVE', 1)}, both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, p.b FROM reach r JOIN both_ways p ON p.a = r.b),
 rooted AS (SELECT a AS id, min(b) AS root FROM (SELECT a, b FROM reach UNION SELECT a, a FROM reach) GROUP BY 1),
 groups AS (SELECT v.space_id, root, count(*) AS n, concat('near:', sha256(concat_ws('|', space_id, CAST(count(*) AS VARCHAR), CAST(bit_xor(CAST(concat('0x', substr(md5(CAST(id AS VARCHAR)), 1, 15)) AS BIGINT)) AS VARCHAR)))) AS review_id FROM rooted JOIN v USING (id) GROUP BY 1, 2)"""
GROUPS = f"{NEAR} SELECT space_id, root, n, review_id FROM groups"
query("near_dup_components", GROUPS)(lambda c: vectors.near_groups(spaces(c, 3), vectors.near_links(spaces(c, 3), LEAST)))
query("near_dup_ann", GROUPS)(lambda c: vectors.near_groups(spaces(c, 3), ann.near_links(spaces(c, 3), LEAST)))
query("near_dup_members", f"{NEAR} SELECT v.space_id, id, root FROM rooted JOIN v USING (id)")(lambda c: vectors.near_members(spaces(c, 3), vectors.near_links(spaces(c, 3), LEAST)))
query("near_dup_window", f"{PAIRS} SELECT a, b FROM pairs")(lambda c: vectors.close_pairs(spaces(c, 3), LEAST, 2000))
WINDOW = f"{sql_spaces(3)}, w AS (SELECT * FROM v WHERE space_id > 'space-0' OR (space_id = 'space-0' AND id > 40) ORDER BY space_id, id LIMIT 120)"
query("near_dup_keyset", f"{WINDOW} SELECT x.id AS a, y.id AS b, (SELECT count(*) > 120 FROM v WHERE space_id > 'space-0' OR (space_id = 'space-0' AND id > 40)) AS partial FROM w x JOIN w y ON x.space_id = y.space_id AND x.id < y.id AND list_cosine_similarity(x.vec, y.vec) >= 0.3")(lambda c: vectors.window_pairs(spaces(c, 3), ("space-0", 40), 120, 0.3))
query("near_review_id", f"{NEAR} SELECT root, review_id FROM groups")(lambda c: vectors.near_groups(spaces(c, 3), vectors.near_links(spaces(c, 3), LEAST)).select("root", "review_id"))
query("near_pair_counts", f"{PAIRS} SELECT a, count(*) AS n FROM pairs GROUP BY 1")(lambda c: vectors.close_pairs(spaces(c, 3), LEAST).groupBy("a").agg(F.count(F.lit(1)).alias("n")))


@query("dup_review_snapshot", f"{NEAR} SELECT CASE WHEN root % 3 = 2 THEN concat('near:', sha256(review_id)) ELSE review_id END AS review_id, CASE root % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'foreign' ELSE 'stale' END AS outcome, CASE WHEN root % 3 = 0 THEN 1 ELSE 0 END AS removed FROM groups")
def dup_review_snapshot(c: Catalog) -> DataFrame:
    """Decisions on all near groups as they were shown: one names a stranger, one a group that was never shown."""
    rows = spaces(c, 3)
    members = settled(vectors.near_members(rows, ann.near_links(rows, LEAST)))
    groups = vectors.groups_of(members)
    shots = snapshots.ReviewSnapshots(c.spark, f"{shared_folder(c.spark)}/reviews-{uuid.uuid4().hex}")
    shots.take(members.join(groups, ["space_id", "root"]), {f"space-{k}": 1 for k in range(3)}, 5_000)
    review = F.when(F.col("root") % 3 == 2, F.concat(F.lit("near:"), F.sha2("review_id", 256))).otherwise(F.col("review_id"))
    decisions = groups.select(review.alias("review_id"), F.when(F.col("root") % 3 == 1, F.lit(-1)).otherwise(F.col("root")).alias("keep"), F.array("root").alias("removals"))
    found = shots.decided(decisions, rows.select("id"), {f"space-{k}": 1 for k in range(3)}, 6_000)
    return found.select("review_id", "outcome", F.size("removed").alias("removed"))
