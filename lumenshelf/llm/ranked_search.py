"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenshelf.functions.workers import map_arrow
from lumenshelf.llm.common import cut, map_rows, sized

TOP = 10
#: Maximal runs of ASCII letters, digits and everything beyond ASCII, in UTF-8 after bytes were lower-cased.
TERM = rb"[0-9a-z\x80-\xff]+"
#: Query terms that a task may hold to pick postings while it reads the texts. More terms are joined by shuffle.
MAX_PICKED = 200_000
#: Terms, repeats across items included, of a block of items that is answered at once, and the
#: documents times items whose scores a task holds.
BLOCK_TERMS, SCORES_AT_ONCE = 200_000, 1 << 20


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order; only A-Z are lower-cased, and null has none."""
    return [t.decode() for t in re.findall(TERM, text.encode().lower())] if text else []


@dataclass
class Index:
    """postings: term, doc, tf, m, restricted to the terms asked for; docs: doc, id of every row with a term;
    n_docs and n_terms count all documents with a term and all their terms."""

    postings: DataFrame
    docs: DataFrame
    n_docs: int
    n_terms: int


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings of the terms (column term, distinct) in all whole texts.

    Every row is a document of its own (column doc), so repeated rows and ids stay apart. Up to MAX_PICKED
    terms go along with the reading, so that a text gives only the postings asked for; more are
    joined by shuffle after all postings are out.
    """
    picked = {r["term"] for r in terms.limit(MAX_PICKED + 1).collect()}
    wanted = {t.encode() for t in picked} if len(picked) <= MAX_PICKED else None

    def start():
        find = re.compile(TERM).findall

        def one(doc, text):
            found = find(text.encode().lower()) if text else []
            counts = Counter(found if wanted is None else filter(wanted.__contains__, found))
            return doc, len(found), [{"term": t.decode(), "tf": n} for t, n in counts.items()]

        return one

    forward = cut(map_rows(docs, start, "id long, n long, terms array<struct<term:string,tf:long>>", [id_col, text_col]).where("n > 0").withColumn("doc", F.monotonically_increasing_id()))
    n_docs, n_terms = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # 90 * n * N may leave the 64 bits of the contract's arithmetic at a very large N.
    m = F.expr(f"CAST(10 + (CAST(90 AS DECIMAL(20,0)) * n * {n_docs}) div {max(n_terms, 1)} AS BIGINT)")
    postings = forward.select("doc", m.alias("m"), F.explode("terms").alias("p")).select(F.col("p.term").alias("term"), "doc", F.col("p.tf").alias("tf"), "m")
    if wanted is None:
        postings = postings.join(terms, "term", "left_semi")
    return Index(postings, forward.select("doc", "id"), n_docs, n_terms)


def scored_lists(found: Index) -> tuple[DataFrame, DataFrame]:
    """The lists and their descriptions: (no, doc, c) and (term, no, df, w).

    c is what a posting adds to a score; postings that add nothing are left out. Lists are partitioned
    by range of (list, c descending), so each is in order and a list with a third of all documents is
    spread over many partitions.
    """
    df = found.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * found.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    lists = cut(df.withColumn("w", weight).withColumn("no", F.monotonically_increasing_id()))
    narrow, _ = sized(lists.select("term", "no", "w"))
    c = F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))")
    postings = found.postings.join(narrow, "term").select("no", "doc", c.alias("c")).where("c > 0")
    return cut(postings.repartitionByRange("no", F.col("c").desc()).sortWithinPartitions("no", F.col("c").desc())), lists


@dataclass
class Questions:
    """A block of items over their lists, in arrays that travel with tasks: for each list (sorted numbers) its
    items, as places, from ``at`` on; and per item its number of lists, its threshold and what unseen lists may hold."""

    items: np.ndarray
    lists: np.ndarray
    at: np.ndarray
    places: np.ndarray
    n_lists: np.ndarray
    heads: np.ndarray
    least: np.ndarray
    need: np.ndarray
    unseen: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, int, int]]) -> Questions:
        """Of (item, list, greatest entry of the list), without thresholds yet."""
        item, no, head = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        items, place = np.unique(item, return_inverse=True)
        order = np.argsort(no, kind="stable")
        lists, at = np.unique(no[order], return_index=True)
        zero = np.zeros(len(items), np.int64)
        return Questions(items, lists, np.append(at, len(no)), place[order], np.bincount(place, minlength=len(items)), head[order], zero, zero, zero)

    def above(self, least: dict[int, int]) -> Questions:
        """With the k-th lower bound of each item. A list's entry counts from the bound over the number of lists;
        an unseen list holds less than that, and no more than its greatest entry."""
        bound = np.array([least.get(i, 0) for i in self.items.tolist()], np.int64)
        need = -(-bound // np.maximum(self.n_lists, 1))
        unseen = np.bincount(self.places, np.minimum(self.heads, np.maximum(need[self.places] - 1, 0)), len(self.items))
        return replace(self, least=bound, need=need, unseen=unseen.astype(np.int64))

    def floors(self) -> list[tuple[int, int]]:
        """Each list's lowest threshold among its items."""
        return list(zip(self.lists.tolist(), np.minimum.reduceat(self.need[self.places], self.at[:-1]).tolist()))

    def sums(self, sizes: np.ndarray, no: np.ndarray, c: np.ndarray, from_need: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of documents with so many entries each: per document and item the sum and number of its entries, all or
        those from the item's threshold on."""
        where = np.searchsorted(self.lists, no)
        width = self.at[where + 1] - self.at[where]
        entry = np.repeat(np.arange(len(no)), width)
        item = self.places[np.arange(len(entry)) - np.repeat(np.cumsum(width) - width, width) + self.at[where][entry]]
        doc = np.repeat(np.arange(len(sizes)), sizes)[entry]
        value = c[entry]
        if from_need:
            kept = value >= self.need[item]
            item, doc, value = item[kept], doc[kept], value[kept]
        shape, key = (len(sizes), len(self.items)), doc * len(self.items) + item
        # Sums stay far below 2^53, where doubles are exact.
        total = np.bincount(key, value, shape[0] * shape[1]).astype(np.int64).reshape(shape)
        return total, np.bincount(key, minlength=shape[0] * shape[1]).reshape(shape)


def by_document(entries: DataFrame) -> DataFrame:
    """Entries (no, doc, c) as one row per document, which holds no more entries than the document has terms."""
    return entries.groupBy("doc").agg(F.collect_list("no").alias("nos"), F.collect_list("c").alias("cs"))


def over_documents(grouped: DataFrame, asked: Questions, pick, schema: str) -> DataFrame:
    """pick(docs, sizes, nos, cs) for runs of documents, so many that a table of documents and items stays small."""

    def run(batches):
        for batch in batches:
            step = max(1, SCORES_AT_ONCE // max(len(asked.items), 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                docs, nos, cs = (part.column(k) for k in range(3))
                yield from pick(docs.to_numpy(), np.diff(nos.offsets.to_numpy()), nos.flatten().to_numpy(), cs.flatten().to_numpy())

    return map_arrow(grouped.select("doc", "nos", "cs"), run, schema)


def best_scores(grouped: DataFrame, asked: Questions, k: int) -> DataFrame:
    """item, doc and exact score of the documents that are among the k best of an item in their run, ties included,
    and reach the item's lower bound."""

    def pick(docs, sizes, nos, cs):
        total, _ = asked.sums(sizes, nos, cs, False)
        kth = np.partition(total, -k, axis=0)[-k] if len(docs) > k else np.zeros(len(asked.items), np.int64)
        doc, item = np.nonzero((total > 0) & (total >= np.maximum(kth, asked.least)))
        yield pa.RecordBatch.from_arrays([pa.array(asked.items[item]), pa.array(docs[doc]), pa.array(total[doc, item])], ["item", "doc", "score"])

    return over_documents(grouped, asked, pick, "item long, doc long, score long")


def top_documents(postings: DataFrame, heads: DataFrame, asked: Questions, k: int = TOP) -> DataFrame:
    """The documents that can be among the k best of each item, with exact scores: item, doc, score.

    postings: no, doc, c > 0; heads: the k largest entries of each list. Documents that tie with the k-th best are all here.

    1. The heads name documents. What these have in all lists are lower bounds of the k best scores; the k-th
       largest of an item, over its number of lists, is its uniform threshold.
    2. Each list gives all entries that reach the lowest threshold of its items. A document in none of an item's
       lists scores less than the k-th lower bound, so it is out. What a document may still have in a list where it was not seen
       is less than the threshold and no more than the list's first entry; documents whose upper bound is below
       the k-th lower bound go.
    3. The exact scores of the remaining documents are looked up.

    Entries move by document and not by document and item.
    """
    named, _ = sized(heads.select("doc").distinct())
    first = best_scores(by_document(postings.join(named, "doc", "left_semi")), asked, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    kth = first.withColumn("_r", F.row_number().over(order)).where(f"_r <= {k}").groupBy("item").agg(F.min("score").alias("kth"), F.max("_r").alias("n")).where(f"n = {k}")
    asked = asked.above({r["item"]: r["kth"] for r in kth.collect()})

    spark = postings.sparkSession
    floors, _ = sized(spark.createDataFrame(asked.floors(), "no long, floor long"))
    high = postings.join(floors, "no").where("c >= floor").drop("floor")

    def pick(docs, sizes, nos, cs):
        low, seen = asked.sums(sizes, nos, cs, True)
        upper = low + asked.unseen - seen * np.maximum(asked.need - 1, 0)
        alive = ((seen > 0) & (upper >= asked.least)).any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(docs[alive])], ["doc"])

    alive, _ = sized(over_documents(by_document(high), asked, pick, "doc long"))
    return best_scores(by_document(postings.join(alive, "doc", "left_semi")), asked, k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k documents that score highest for each item: item id, rank, doc id, score.

    Only scores above 0 count, equal scores go by ascending document id, null last. Each row of docs is a
    document: repeated rows appear once each. Items equal in id and text are one item; items that share
    an id but not the text are ranked apart. Texts without terms, null ones too, match nothing, and an item
    without terms in the corpus has no rows, as has every item over an empty table.
    """

    def start():
        return lambda item, text: (item, text, sorted(set(terms_of(text))))

    questions = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    questions = cut(map_rows(questions, start, "item_id long, text string, terms array<string>", ["item_id", "text"]).select("item_id", "terms").withColumn("item", F.monotonically_increasing_id()))
    asked = cut(questions.select("item", F.explode("terms").alias("term")))
    found = index(docs, asked.select("term").distinct(), id_col, text_col)
    postings, lists = scored_lists(found)
    order = Window.partitionBy("no").orderBy(F.desc("c"), "doc")
    heads = cut(postings.withColumn("_r", F.row_number().over(order)).where(f"_r <= {k}").drop("_r"))
    met = cut(asked.join(lists, "term").join(heads.groupBy("no").agg(F.max("c").alias("head")), "no").select("item", "no", "head"))
    blocks = -(-met.count() // BLOCK_TERMS)
    answers = []
    for block in range(blocks):
        rows = met.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        if rows:
            told = Questions.of(rows)
            if blocks > 1:
                mine, _ = sized(docs.sparkSession.createDataFrame([(n,) for n in told.lists.tolist()], "no long"))
                answers.append(top_documents(postings.join(mine, "no", "left_semi"), heads.join(mine, "no", "left_semi"), told, k))
            else:
                answers.append(top_documents(postings, heads, told, k))
    if not answers:
        return docs.sparkSession.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long")
    exact = cut(reduce(DataFrame.unionByName, answers))
    wanted, _ = sized(exact.select("doc").distinct())
    named = exact.join(found.docs.join(wanted, "doc"), "doc")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = named.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.join(questions.select("item", "item_id"), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
