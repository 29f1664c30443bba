"""Exact top-k by inner product as a Voronoi join.

Pivots from a bounded sample group queries and data into cells.  Summaries of the data cells (rows, radius
around the pivot, least and largest norm, widest angle from the pivot) bound the score that any row of a cell
can have with a query: q.p + |q| radius by distance, and |q| norm cos(angle to the pivot - widest angle) by
direction.  Every query is first solved in its home, the cells whose pivots score best until they hold
``HOME_ROWS`` rows.  Its k-th best score there is reached by every row that still matters, so it goes on only
to the cells whose bound is not below that score, and only cells that some query needs are sent at all.  Large
cells are split into blocks of bounded size; each block is solved locally in exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import materialize
from tallyfield.llm.vectors import LISTS, LISTS_ARROW, common_length, matrix, merged, top_lists, whole

SCALE = 1024
#: Cells: the square root of the number of rows over this, and at most; both steps of a query look at all pivots.
CELL_SHARE, MOST_PIVOTS = 4, 1024
SAMPLE_ROWS = 16_384
#: Rows of the cells in which a query finds its first bound.
HOME_ROWS = 512
BLOCK_ROWS = 8_192
SLICE = 2048
_ROWS = "cell int, block int, vec_id long, mark long, vec array<long>"


def _as_double(batch, column="vec") -> np.ndarray:
    return matrix(batch.column(column), np.int64).astype(np.float64)


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Means of ``count`` groups of the sample: rows spread over it, moved to their groups' means."""
    pivots = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        group = nearest_pivot(sample, pivots)[0]
        for i in range(len(pivots)):
            if (group == i).any():
                pivots[i] = sample[group == i].mean(axis=0)
    return pivots


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = ((x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T).clip(0)
    group = apart.argmin(axis=1)
    return group, np.sqrt(((x - pivots[group]) ** 2).sum(axis=1))


@dataclass(frozen=True)
class Cells:
    """Pivots, and for each cell its rows, radius, least and largest norm, and widest angle from the pivot."""

    pivots: np.ndarray
    n: np.ndarray
    radius: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    angle: np.ndarray

    def home(self, q: np.ndarray, rows: int) -> np.ndarray:
        """For each query the cells it looks at first, as a (queries, cells) mask."""
        order = np.argsort(-(q @ self.pivots.T), axis=1, kind="stable")
        held = self.n[order]
        first = (np.cumsum(held, axis=1) - held < rows) & (held > 0)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, first, axis=1)
        return out

    def highest(self, q: np.ndarray) -> np.ndarray:
        """A bound that no row of a cell exceeds, as a (queries, cells) matrix."""
        along, norm = q @ self.pivots.T, np.sqrt((q**2).sum(axis=1))[:, None]
        lengths = np.sqrt((self.pivots**2).sum(axis=1))[None, :]
        near = along + norm * self.radius
        with np.errstate(divide="ignore", invalid="ignore"):
            away = np.arccos(np.clip(along / (norm * lengths), -1, 1))
        cos = np.cos(np.maximum(0, np.nan_to_num(away) - self.angle))
        ahead = norm * np.where(cos > 0, self.longest, self.shortest) * cos
        bound = np.where((norm > 0) & (lengths > 0), np.minimum(near, ahead), near)
        return bound + 1e-9 * (np.abs(bound) + norm * self.longest) + 1e-6


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between rows and their pivots; pi where one has no direction."""
    lengths = np.sqrt((x**2).sum(axis=1) * (pivots**2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = (x * pivots).sum(axis=1) / lengths
    return np.where(lengths > 0, np.arccos(np.clip(np.nan_to_num(cos), -1, 1)), np.pi)


_SUMMARY = ("n", "radius", "shortest", "longest", "angle")


def _summaries(pivots: np.ndarray):
    """For each task and cell what :class:`Cells` holds."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius, longest, angle = (np.zeros(len(pivots)) for _ in range(4))
        shortest = np.full(len(pivots), np.inf)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                x = _as_double(batch.slice(lo, SLICE))
                cell, apart = nearest_pivot(x, pivots)
                norm = np.sqrt((x**2).sum(axis=1))
                np.add.at(n, cell, 1)
                np.maximum.at(radius, cell, apart)
                np.minimum.at(shortest, cell, norm)
                np.maximum.at(longest, cell, norm)
                np.maximum.at(angle, cell, _angles(x, pivots[cell]))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *(pa.array(c[held]) for c in (n, radius, shortest, longest, angle))], ["cell", *_SUMMARY])

    return summed


def summarized(rows: DataFrame, pivots: np.ndarray) -> Cells:
    by = rows.mapInArrow(_summaries(pivots), "cell int, " + ", ".join(f"{c} double" for c in _SUMMARY))
    by = by.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"), F.max("angle").alias("angle"))
    out = np.zeros((len(_SUMMARY), len(pivots)))
    for r in by.collect():  # a row for each pivot
        out[:, r["cell"]] = [r[c] for c in _SUMMARY]
    slack = 1 + 1e-9
    return Cells(pivots, out[0], out[1] * slack, out[2] / slack, out[3] * slack, out[4] + 1e-7)


def _spread(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int32)


def _copied(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    taken = [batch.column(c).take(pa.array(row)) for c in ("vec_id", "mark", "vec")]
    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), *taken], ["cell", "block", "vec_id", "mark", "vec"])


def _to_cells(cells: Cells, blocks: np.ndarray, needed: np.ndarray):
    """The rows of the cells that are needed, each once."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                cell, _ = nearest_pivot(_as_double(part), cells.pivots)
                row = np.flatnonzero(needed[cell])
                yield _copied(part, row, cell[row], _spread(part.column("vec_id").to_numpy()[row], blocks[cell[row]]))

    return deal


def _to_blocks(cells: Cells, blocks: np.ndarray, rows: int, onward: bool):
    """Queries to all blocks of their home cells or, ``onward``, of the other cells whose bound reaches ``least``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                part = batch.slice(lo, 16)
                q = _as_double(part)
                open_ = cells.home(q, rows)
                if onward:
                    least = part.column("least").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    open_ = ~open_ & (cells.n > 0) & (cells.highest(q) >= least[:, None])
                row, cell = np.nonzero(open_)
                each = blocks[cell]
                block = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                yield _copied(part, np.repeat(row, each), np.repeat(cell, each), block)

    return deal


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 64 bits they stop at the largest and smallest long."""
    if float(np.abs(a).astype(np.float64).sum()) * float(np.abs(b).max(initial=0)) < 2.0**62:
        return b @ a
    top = (1 << 63) - 1
    return np.array([max(-top - 1, min(top, int(sum(int(p) * int(q) for p, q in zip(a, r, strict=True))))) for r in b], np.int64)


def _columns(table: pa.Table) -> tuple:
    return table.column("vec_id").to_numpy(), table.column("mark").to_numpy(), matrix(table.column("vec"), np.int64)


def _solve(k: int):
    def solve(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return LISTS_ARROW.empty_table()
        q, x = _columns(queries), _columns(rows)
        largest = float(np.abs(q[2].astype(np.float64)).sum(axis=1).max()) * float(np.abs(x[2].astype(np.float64)).max())
        slack = 0.0 if largest < 2.0**53 else largest * 2.0**-48
        return top_lists(q, x, k, lambda a, b: a.astype(np.float64) @ b.astype(np.float64).T, _exact, slack)

    return solve


def quantized(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: for rows of (vec_id, embedding) whose id is divisible by ``every``,
    the ``k`` rows of largest integer inner product of the quantized vectors, ties to smaller ids.

    Vectors that are null or hold null or non-finite components, vectors of another length than most, and
    null ids take no part; zero vectors do.  A row with the query's own id is no candidate; rows that repeat
    id and vector count once.  Fewer than ``k`` candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).where(F.col("vec_id").isNotNull() & whole(F.col("vec")))
    rows = rows.withColumn("mark", F.xxhash64(F.col("vec").cast("array<double>")))
    length = common_length(rows)
    rows = materialize(rows.where(F.size("vec") == length).withColumn("vec", quantized(F.col("vec"))), "knn-rows")
    asked = rows.where(F.col("vec_id") % every == 0)
    total, queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(9)), "mark").limit(SAMPLE_ROWS).select("vec").toArrow()
    pivots = choose_pivots(_as_double(sample), min(MOST_PIVOTS, math.ceil(math.sqrt(total) / CELL_SHARE)))
    cells = summarized(rows, pivots)
    blocks = np.maximum(1, -(-cells.n // BLOCK_ROWS)).astype(np.int64)

    def solved(asked: DataFrame, onward: bool) -> DataFrame:
        sent = materialize(asked.mapInArrow(_to_blocks(cells, blocks, HOME_ROWS, onward), _ROWS), "knn-asked")
        needed = np.zeros(len(pivots), bool)
        needed[[r["cell"] for r in sent.select("cell").distinct().collect()]] = True  # at most a row for each pivot
        data = rows.mapInArrow(_to_cells(cells, blocks, needed), _ROWS)
        lists = sent.groupBy("cell", "block").cogroup(data.groupBy("cell", "block")).applyInArrow(_solve(k), LISTS)
        return materialize(lists, "knn-lists")

    first = solved(asked, onward=False)
    least = merged(first, k, "long", marked=True).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "mark", F.col("score").cast("double").alias("least"))
    rest = solved(asked.dropDuplicates(["vec_id", "mark"]).join(least, ["vec_id", "mark"], "left"), onward=True)
    return merged(first.unionByName(rest), k, "long")
