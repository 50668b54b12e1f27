"""Vector code compression: product codes whose codebooks come from Lloyd rounds filtered through kd-trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.workers import map_arrow
from lumenshelf.llm.common import cut, join_groups

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a partition that one set of trees covers, and points of a leaf.
TREE_ROWS, LEAF_POINTS = 8192, 32
#: Nodes whose boxes are held against the entries at once.
NODES_AT_ONCE = 256
#: Scaled components from here on count as not finite, so that sums stay within decimal(38).
TOO_LARGE = 1e27
MOST = 2**63 - 1

Codebooks = list[np.ndarray]


def usable(vec: str) -> Column:
    """Whether a vector is there and has only finite components."""
    values = F.col(vec).cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * SCALE >= TOO_LARGE))
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(False))


def kept_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The usable rows: id, vec (doubles), label (a string that is never null)."""
    label = F.coalesce(F.concat(F.lit("s"), F.col(label_col).cast("string")), F.lit("n"))
    return vectors.where(usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), label.alias("label"))


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of a column of vectors as whole doubles; short vectors are padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(out * SCALE)


def exact(values: np.ndarray, largest: float) -> np.ndarray:
    """Doubles where every product sum of the search is below 2^53, else Python's own integers."""
    if 8 * values.shape[-1] * max(largest, 1.0) ** 2 < 2.0**53:
        return values.astype(np.float64)
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


class Tree:
    """A kd-tree over the points of one part: boxes, sums and counts of every node.

    Points are kept in the order of the leaves, so a node is the range first..last of them. A node is
    split at the median of its widest dimension; points that are all equal stay one leaf.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        first, last, left = [0], [len(points)], []
        low, high, total = [], [], []
        node = 0
        while node < len(first):
            a, b = first[node], last[node]
            of = points[self.order[a:b]]
            lo, hi = of.min(axis=0), of.max(axis=0)
            low.append(lo), high.append(hi), total.append(of.sum(axis=0))
            if b - a <= LEAF_POINTS or (lo == hi).all():
                left.append(-1)
            else:
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(of[:, np.argmax(hi - lo)], middle)]
                left.append(len(first))
                first += [a, a + middle]
                last += [a + middle, b]
            node += 1
        self.first, self.last, self.left = np.array(first), np.array(last), np.array(left)
        fits = np.int16 if max(np.abs(low).max(), np.abs(high).max()) < 2**15 else np.float64
        self.low, self.high, self.points = np.array(low, fits), np.array(high, fits), points[self.order].astype(fits)
        # A sum of doubles may be rounded, unlike the points themselves.
        self.total = np.array(total, np.int64) if fits is np.int16 else np.array([[sum(map(int, col)) for col in self.points[a:b].T] for a, b in zip(first, last)], object)

    def assign(self, entries: np.ndarray) -> Iterator[tuple[int, int, int, int | np.ndarray]]:
        """Ranges of points and their nearest entry: (node, first, last, entry), or of a leaf whose points
        differ (-1, first, last, entries).

        All nodes of a level are held against the entries at once. The entry nearest to the middle of a
        box is its favourite; another entry goes if even the corner that lies furthest towards it is
        nearer to the favourite, or as near and the favourite has the lower index. A node with one entry
        left is assigned whole; a leaf compares its points with what is left.
        """
        largest = float(max(np.abs(self.points).max(), max(abs(x) for x in entries.flat)))
        z = exact(entries, largest)
        z_norm = (z * z).sum(axis=1)
        apart = np.abs(z[:, None, :] - z[None, :, :])
        index = np.arange(len(z))
        level, alive = np.array([0]), np.ones((1, len(z)), bool)
        while len(level):
            next_level, next_alive = [], []
            for at in range(0, len(level), NODES_AT_ONCE):
                nodes, open_ = level[at : at + NODES_AT_ONCE], alive[at : at + NODES_AT_ONCE]
                lo, hi = exact(self.low[nodes], largest), exact(self.high[nodes], largest)
                towards = (lo + hi) @ z.T
                middle = np.where(open_, z_norm - towards, np.inf)
                best = middle.argmin(axis=1)
                rows = np.arange(len(nodes))
                reach = towards - towards[rows, best][:, None] + (apart[best] * (hi - lo)[:, None, :]).sum(axis=2)
                margin = z_norm - z_norm[best][:, None] - reach
                gone = (margin > 0) | ((margin == 0) & (index > best[:, None]))
                open_ = open_ & ~gone.astype(bool)
                open_[rows, best] = True
                single = open_.sum(axis=1) == 1
                for k in np.flatnonzero(single):
                    yield int(nodes[k]), int(self.first[nodes[k]]), int(self.last[nodes[k]]), int(best[k])
                for k in np.flatnonzero(~single & (self.left[nodes] < 0)):
                    a, b = int(self.first[nodes[k]]), int(self.last[nodes[k]])
                    left = np.flatnonzero(open_[k])
                    near = left[(z_norm[left] - 2 * (exact(self.points[a:b], largest) @ z[left].T)).argmin(axis=1)]
                    yield -1, a, b, near
                down = ~single & (self.left[nodes] >= 0)
                next_level += [self.left[nodes[down]], self.left[nodes[down]] + 1]
                next_alive += [open_[down], open_[down]]
            level, alive = np.concatenate(next_level), np.concatenate(next_alive)

    def sums(self, entries: np.ndarray) -> tuple[list[list[int]], list[int]]:
        """Of the points nearest to each entry, the sum and the count."""
        kind = self.total.dtype
        totals, counts = np.zeros((len(entries), self.points.shape[1]), kind), np.zeros(len(entries), np.int64)
        for node, a, b, entry in self.assign(entries):
            if node >= 0:
                totals[entry] += self.total[node]  # at hand
                counts[entry] += b - a
            else:
                np.add.at(totals, entry, self.points[a:b].astype(kind) if kind != object else np.array([[int(x) for x in p] for p in self.points[a:b]], object))
                np.add.at(counts, entry, 1)
        return [[int(x) for x in t] for t in totals], counts.tolist()

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point and its squared distance, in the order the points came."""
        found = np.zeros(len(self.order), np.int64)
        for _, a, b, entry in self.assign(entries):
            found[a:b] = entry
        largest = float(max(np.abs(self.points).max(), max(abs(x) for x in entries.flat)))
        off = exact(self.points, largest) - exact(entries, largest)[found]
        back = np.argsort(self.order)
        return found[back], (off * off).sum(axis=1)[back]


def plant(rows: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """Trees over the kept rows of every partition: ids, labels, trees (one per part, as bytes).

    A row of the result covers up to TREE_ROWS rows of one partition, and is built once: the rounds and
    the encoding read the trees again. The table is cut, so a lost executor costs no rebuilding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown(of: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(of).combine_chunks()
            values = scaled(table["vec"].chunk(0), width)
            trees = [pickle.dumps(Tree(p)) for p in np.split(values, parts, axis=1)]
            return pa.RecordBatch.from_arrays([pa.array([table[c].to_pylist()], pa.list_(t)) for c, t in (("id", pa.int64()), ("label", pa.string()))] + [pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                piece = batch.slice(at, TREE_ROWS)
                while piece.num_rows:
                    taken = piece.slice(0, TREE_ROWS - n)
                    held.append(taken)
                    n += taken.num_rows
                    piece = piece.slice(taken.num_rows)
                    if n == TREE_ROWS:
                        yield grown(held)
                        held, n = [], 0
        if n:
            yield grown(held)

    return cut(map_arrow(rows, run, "ids array<long>, labels array<string>, trees array<binary>"))


def first_codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """Each part of the vectors with the least ids; rows without an id come last, equal ids by vector."""
    least = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").toArrow().combine_chunks()
    vecs = least["vec"].chunk(0) if least.num_rows else pa.array([], pa.list_(pa.float64()))
    values = scaled(vecs.cast(pa.list_(pa.float64())), width)
    return [np.array([[int(x) for x in row] for row in p], object).reshape(p.shape) for p in np.split(values, parts, axis=1)]


def lloyd_round(trees: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of its parts, one without parts stays.

    A task sums over all of its trees, so it sends at most one row per entry and position; the driver
    receives the new codebooks, which have a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for row in batch.column(0):
                for k, tree in enumerate(row):
                    sums, n = pickle.loads(tree.as_py()).sums(books[k])
                    totals[k] = totals[k] + np.array(sums, object).reshape(books[k].shape)
                    counts[k] += np.array(n, np.int64)
        rows = [(k, e, p, Decimal(x), int(counts[k][e])) for k in range(len(books)) for e in np.flatnonzero(counts[k]).tolist() for p, x in enumerate(totals[k][e])]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["part", "entry", "position", "total", "n"])

    sums = map_arrow(trees.select("trees"), run, "part int, entry int, position int, total decimal(38,0), n long")
    new = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        new[r["part"]][r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return new


def assigned(trees: DataFrame, books: Codebooks) -> DataFrame:
    """Codes of all rows: id, label, code (an entry per part), error (squared distances summed over parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, row in zip(*batch.columns):
                found = [pickle.loads(tree.as_py()).codes(books[k]) for k, tree in enumerate(row)]
                codes = np.stack([c for c, _ in found], axis=1)
                errors = [min(int(x), MOST) for x in sum(e.astype(object) for _, e in found)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    return map_arrow(trees.select("ids", "labels", "trees"), run, "id long, label string, code array<int>, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Product codes of all usable vectors and their codebooks: (id, label, code, error), codebooks.

    Rows whose vector is null or has null or non-finite components have no code; components of 10^27 / 1024
    or more count as not finite, and errors end at 2^63 - 1. Vectors shorter than the longest count as padded with zeros, as
    does a length that the parts do not divide. Repeated rows are coded each; null ids are last in order;
    null labels are one label. Without usable rows the result is empty and so are the codebooks.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits, so at most 256 entries")
    rows = kept_rows(vectors, id_col, vec_col, label_col)
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    width = max(-(-longest // parts), 1) * parts
    books = first_codebooks(rows, width, parts, entries)
    trees = plant(rows, width, parts)
    if len(books[0]):
        for _ in range(rounds):
            books = lloyd_round(trees, books)
    return assigned(trees, books), books


def codebooks_digest(books: Codebooks) -> str:
    return sha256(",".join(str(x) for book in books for x in book.flat).encode()).hexdigest()


def decompress(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The vectors that codes (id, code) stand for: id, vec. The codebooks have a fixed size, so they travel as a literal."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x) / SCALE) for x in e]) for e in b]) for b in books])
    return codes.select("id", F.flatten(F.transform("code", lambda c, k: table[k][c])).alias("vec"))


def digests(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per usable row: vec_id, code (hex), error, label_error, codebooks_sha256."""
    coded, books = compress(vectors, id_col, vec_col, label_col)
    coded = cut(coded)
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    joined = join_groups(coded, cut(sums), "label", "n", coded.count(), F.col("id"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return joined.select(F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
