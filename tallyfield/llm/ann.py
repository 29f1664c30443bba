"""Approximate nearest neighbours: a forest of random-projection trees, then exact reranking.

A bounded sample gives every tree its hyperplanes: of several directions between two drawn rows the one along
which the rows spread most, cut at their median.  A further coordinate gives all rows the largest norm, and
none of it goes to the queries, which are scaled to that norm: the nearest rows are then those of largest inner
product, whatever their own norms.  All rows are dealt out to one leaf of each tree.

A leaf's value for a query is the sum of the margins by which the query lies on the leaf's side of the
hyperplanes above it (negative where it lies on the other side): it stands for the inner product with the
leaf's rows.  A branch waits in one priority queue for all trees with the best value among its leaves, so leaves
come out best first.  A query takes leaves until they hold ``SEARCH`` times the number of rows (a row is in
one leaf of each tree).  The rows of the leaves it takes are scored exactly.  Leaves are joined with their
queries in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tallyfield.llm.common import materialize
from tallyfield.llm.vectors import LISTS, LISTS_ARROW, common_length, matrix, merged, top_lists, whole

TREES = 16
#: Leaves of a tree: at least, rows of each beyond that, and at most; the forest's size stays bounded.
LEAST_LEAVES, LEAF_ROWS, MOST_LEAVES = 256, 1024, 4096
#: Leaf rows that a query takes over all trees, as a share of all rows (a row counts in each tree).
SEARCH = 0.75
#: Directions that a hyperplane is chosen from, and the rows their spread is measured on.
DIRECTIONS, SPREAD_ROWS = 8, 256
SAMPLE_ROWS = 20_000
BLOCK_ROWS = 16_384


@dataclass(frozen=True)
class Tree:
    """A full binary tree of hyperplanes in heap order: node i has the children 2i and 2i + 1."""

    normals: np.ndarray
    offsets: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.offsets)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.leaves.bit_length() - 1):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.normals[node]) > self.offsets[node])
        return node - self.leaves


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with one more coordinate, which makes ``norm`` the norm of all of them."""
    return np.column_stack((x, np.sqrt(np.maximum(0, norm**2 - (x**2).sum(axis=1)))))


def aimed(x: np.ndarray, norm: float) -> np.ndarray:
    """Queries in the space of lifted rows: of that norm, and nothing in the further coordinate."""
    return np.column_stack((x * (norm / np.sqrt((x**2).sum(axis=1)))[:, None], np.zeros(len(x))))


def grow(sample: np.ndarray, leaves: int, seed: int) -> Tree:
    """A tree over the rows of ``sample``, with ``leaves`` (a power of two) leaves."""
    rng = np.random.default_rng(seed)
    normals, offsets = np.zeros((leaves, sample.shape[1])), np.zeros(leaves)
    inside = {1: np.arange(len(sample))}
    for node in range(1, leaves):
        rows = inside.pop(node)
        if len(rows) > 1:
            ends = sample[rng.choice(rows, (2, DIRECTIONS))]
            normal = ends[0] - ends[1]
            normal[~normal.any(axis=1)] = rng.standard_normal(sample.shape[1])
            normal /= np.linalg.norm(normal, axis=1)[:, None]
            some = rows if len(rows) <= SPREAD_ROWS else rng.choice(rows, SPREAD_ROWS)
            normals[node] = normal[(sample[some] @ normal.T).std(axis=0).argmax()]
            along = sample[rows] @ normals[node]
            offsets[node] = np.median(along)
            inside[2 * node], inside[2 * node + 1] = rows[along <= offsets[node]], rows[along > offsets[node]]
        else:
            inside[2 * node], inside[2 * node + 1] = rows, rows[:0]
    return Tree(normals, offsets)


def branch_values(tree: Tree, query: np.ndarray) -> np.ndarray:
    """For each node in heap order the best value of a leaf below it; the last half are the leaves' own."""
    n = tree.leaves
    margins, values = tree.normals @ query - tree.offsets, np.zeros(2 * n)
    for level in range(n.bit_length() - 1):
        node = np.arange(1 << level, 2 << level)
        values[2 * node], values[2 * node + 1] = values[node] - margins[node], values[node] + margins[node]
    for level in range(n.bit_length() - 2, -1, -1):
        node = np.arange(1 << level, 2 << level)
        values[node] = np.maximum(values[2 * node], values[2 * node + 1])
    return values


def search(trees: list[Tree], sizes: np.ndarray, query: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs a query takes, best first, until their ``sizes`` sum to ``wanted``."""
    values = [branch_values(t, query) for t in trees]
    waiting, found, held = [(-float(v[1]), t, 1) for t, v in enumerate(values)], [], 0
    heapq.heapify(waiting)
    while waiting and held < wanted:
        _, t, node = heapq.heappop(waiting)
        while node < trees[t].leaves:  # the better child has the value that was popped
            left, right = values[t][2 * node], values[t][2 * node + 1]
            node, other, worth = (2 * node, 2 * node + 1, right) if left >= right else (2 * node + 1, 2 * node, left)
            heapq.heappush(waiting, (-float(worth), t, other))
        leaf = node - trees[t].leaves
        found.append((t, leaf))
        held += sizes[t, leaf]
    return found


_ROWS = "tree int, leaf int, block int, vec_id long, mark long, vec "
_ROWS_ARROW = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("block", pa.int32()), ("vec_id", pa.int64()), ("mark", pa.int64()), ("vec", pa.list_(pa.float32()))])


def _dealt(batch: pa.RecordBatch, row: np.ndarray, tree: np.ndarray, leaf: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    taken = [batch.column(c).take(pa.array(row)) for c in ("vec_id", "mark", "vec")]
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (tree, leaf, block)), *taken], schema=_ROWS_ARROW)


def _spread(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _to_leaves(trees: list[Tree], norm: float, blocks: np.ndarray):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = lifted(matrix(part.column("vec"), np.float64), norm)
                spread = _spread(part.column("vec_id").to_numpy())
                for t, tree in enumerate(trees):
                    leaf = tree.leaf(x)
                    yield _dealt(part, np.arange(len(x)), np.full(len(x), t), leaf, (spread % blocks[t, leaf].astype(np.uint64)).astype(np.int64))

    return deal


def _count_leaves(trees: list[Tree], norm: float):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(trees), trees[0].leaves), np.int64)
        for batch in batches:
            x = lifted(matrix(batch.column("vec"), np.float64), norm)
            for t, tree in enumerate(trees):
                n[t] += np.bincount(tree.leaf(x), minlength=tree.leaves)
        t, leaf = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(n[t, leaf])], ["tree", "leaf", "n"])

    return count


def _to_searches(trees: list[Tree], norm: float, sizes: np.ndarray, blocks: np.ndarray, wanted: float):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                taken = [(i, t, leaf, b) for i, q in enumerate(aimed(matrix(part.column("vec"), np.float64), norm)) for t, leaf in search(trees, sizes, q, wanted) for b in range(blocks[t, leaf])]
                yield _dealt(part, *(np.array(x, np.int64) for x in zip(*taken, strict=True)))

    return deal


def _columns(table: pa.Table) -> tuple:
    return table.column("vec_id").to_numpy(), table.column("mark").to_numpy(), matrix(table.column("vec"), np.float64)


def _rerank(k: int):
    def rerank(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return LISTS_ARROW.empty_table()
        q, x = _columns(queries), _columns(rows)
        slack = 1e-12 * max(1.0, float(np.abs(q[2]).sum(axis=1).max()) * float(np.abs(x[2]).max()))
        return top_lists(q, x, k, lambda a, b: a @ b.T, lambda a, b: (b * a).sum(axis=1), slack)

    return rerank


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, trees: int = TREES, share: float = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: for rows of (vec_id, embedding) whose id is divisible by ``every``,
    the ``k`` rows of largest inner product among those found (double precision), ties to smaller ids.

    Vectors that are null, zero or hold null or non-finite components, vectors of another length than most,
    and null ids take no part.  A row with the query's own id is no candidate; rows that repeat id and
    vector count once.  Fewer than ``k`` candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & whole(F.col("vec")) & F.exists("vec", lambda x: x != 0)).withColumn("mark", F.xxhash64("vec"))
    length = common_length(rows)
    rows = rows.where(F.size("vec") == length)
    total, square = rows.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "mark").limit(SAMPLE_ROWS).select("vec").toArrow()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = float(np.sqrt(square))
    sample = lifted(matrix(drawn.column("vec"), np.float64), norm)
    leaves = LEAST_LEAVES
    while leaves < MOST_LEAVES and leaves * LEAF_ROWS < total:
        leaves *= 2
    while leaves > 1 and leaves * 2 > len(sample):
        leaves //= 2
    forest = [grow(sample, leaves, seed) for seed in range(trees)]
    sizes = np.zeros((trees, leaves), np.int64)
    for r in rows.mapInArrow(_count_leaves(forest, norm), "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["tree"], r["leaf"]] = r["n"]
    blocks = np.maximum(1, -(-sizes // BLOCK_ROWS))
    data = rows.mapInArrow(_to_leaves(forest, norm, blocks), _ROWS + kind)
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(_to_searches(forest, norm, sizes, blocks, share * total), _ROWS + kind)
    key = ("tree", "leaf", "block")
    lists = asked.groupBy(*key).cogroup(data.groupBy(*key)).applyInArrow(_rerank(k), LISTS)
    return merged(materialize(lists, "ann-lists"), k, "double")
