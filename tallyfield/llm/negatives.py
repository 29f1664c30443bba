"""Hard negatives for contrastive training, found through a vector-approximation file.

Every dimension is cut into up to 256 cells at quantiles of a bounded sample, and each row keeps one byte for each
dimension: the approximation file.  For an anchor, two small tables hold the least and the largest that a cell of
a dimension can add to its score; looking a row's bytes up and adding gives bounds for its score.  Only rows whose
bounds let them enter a list (same label: the best few; other labels: the best few inside a score window) are
scored on their vectors, in exact integers.  The sample decides how tight bounds are, never what is found.

Rows and anchors are dealt to blocks of bounded size, and a task solves one block of anchors against one block of
rows; each gives a few rows for an anchor, and a window over those keeps the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import materialize, release
from tallyfield.llm.vectors import common_length, matrix, whole

SCALE = 256
CELLS = 256
SAMPLE_ROWS = 16_384
#: Rows and anchors of a block.
BLOCK_ROWS, BLOCK_ANCHORS = 16_384, 2_048
SLICE = 4_096

_ROWS = "vec_id long, mark long, label string, vec array<long>, cells binary"
_FIRST = "anchor_id long, anchor_mark long, vec_id long, mark long, score long"
_FOUND = "anchor_id long, anchor_mark long, positive_id long, positive_mark long, positive_score long, vec_id long, mark long, score long"


@dataclass(frozen=True)
class Cells:
    """For each dimension the cuts between its cells, and the least and largest value that a cell can hold."""

    cuts: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of every component, one byte each."""
        return np.stack([np.searchsorted(c, x[:, d], side="right") for d, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a cell of a dimension adds to the score of ``q``: at least, and at most."""
        a, b = self.least * q[:, None], self.most * q[:, None]
        return np.minimum(a, b), np.maximum(a, b)


def looked_up(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Bounds of rows from their cells, given as (dimensions, rows)."""
    out = np.zeros(cells.shape[1], np.int64)
    for t, c in zip(table, cells, strict=True):
        out += t.take(c)
    return out


def cut(sample: np.ndarray, least: np.ndarray, most: np.ndarray) -> Cells:
    """Cells at quantiles of ``sample`` between the least and largest values of all rows."""
    cuts = np.quantile(sample, np.linspace(0, 1, CELLS + 1)[1:-1], axis=0, method="lower").T.astype(np.int64)
    return Cells(cuts, np.concatenate((least[:, None], cuts), axis=1), np.concatenate((cuts - 1, most[:, None]), axis=1))


def quantized(vector: Column, length: int) -> Column:
    """floor(256 x) of each component, held within bounds that keep every inner product inside 64 bits."""
    limit = float(math.isqrt((1 << 62) // max(1, length)) - 1)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.lit(float(SCALE)) * x.cast("double")))).cast("long"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and largest value of every dimension in a task."""
    low = high = None
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("vec"), np.int64)
            a, b = x.min(axis=0), x.max(axis=0)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], ["place", "low", "high"])


def fitted(rows: DataFrame) -> Cells:
    """Cells for ``rows``: ranges over all of them, cuts from at most ``SAMPLE_ROWS`` with the smallest hash."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(13)), "mark").limit(SAMPLE_ROWS).select("vec").toArrow()
    found = rows.select("vec").mapInArrow(_ranges, "place int, low long, high long").groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("place").collect()  # a row for each dimension
    return cut(matrix(sample.column("vec"), np.int64), np.array([r["low"] for r in found]), np.array([r["high"] for r in found]))


def _approximated(cells: Cells):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                codes = cells.of(matrix(part.column("vec"), np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "mark", "label", "vec")), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "mark", "label", "vec", "cells"])

    return work


class Block:
    """Rows of a block ordered by label, so that the rows of one label lie together."""

    def __init__(self, rows: pa.Table):
        labels = np.array(rows.column("label").to_pylist(), object)
        self.names, of = np.unique(labels, return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.begin = np.searchsorted(of[order], np.arange(len(self.names) + 1))
        self.ids, self.marks = (rows.column(c).to_numpy()[order] for c in ("vec_id", "mark"))
        self.x = matrix(rows.column("vec"), np.int64)[order]
        codes = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(len(order), -1)
        self.cells = np.ascontiguousarray(codes[order].T.astype(np.intp))

    def span(self, label: str) -> slice:
        """Where the rows of a label lie."""
        i = int(np.searchsorted(self.names, label))
        return slice(*self.begin[i : i + 2]) if i < len(self.names) and self.names[i] == label else slice(0, 0)

    def best(self, near: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Positions in ``near`` of the first ``k``: higher scores, then smaller ids."""
        return np.lexsort((self.marks[near], self.ids[near], -score))[:k]


def _positives(cells: Cells, k: int):
    """The ``k`` best rows of an anchor's label in a block."""

    def solve(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        block = Block(rows) if rows.num_rows and anchors.num_rows else None
        for anchor, mark, label, vec in zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "mark", "label", "vec"))) if block else ():
            span = block.span(label)
            other = np.flatnonzero(block.ids[span] != anchor) + span.start
            if not len(other):
                continue
            q = np.array(vec, np.int64)
            low, high = cells.tables(q)
            held = block.cells[:, other]
            floor = looked_up(low, held)
            enough = np.partition(floor, len(floor) - k)[-k] if len(floor) > k else floor.min()
            near = other[looked_up(high, held) >= enough]
            score = block.x[near] @ q
            for i in block.best(near, score, k):
                out.append((anchor, mark, block.ids[near[i]], block.marks[near[i]], score[i]))
        return _table(out, _FIRST)

    return solve


def _negatives(cells: Cells, k: int, low_share: int, high_share: int):
    """For every anchor and positive the ``k`` best rows of other labels inside the positive's window in a block."""

    def solve(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        block = Block(rows) if rows.num_rows and anchors.num_rows else None
        names = ("vec_id", "mark", "label", "vec", "positive_ids", "positive_marks", "positive_scores")
        for anchor, mark, label, vec, ids, marks, scores in zip(*(anchors.column(c).to_pylist() for c in names)) if block else ():
            q, span = np.array(vec, np.int64), block.span(label)
            windows = [(-(-low_share * s // 100), high_share * s // 100) for s in scores]
            low, high = cells.tables(q)
            ceiling = looked_up(high, block.cells)
            open_ = ceiling >= min(w[0] for w in windows)
            open_[span] = False
            open_[block.ids == anchor] = False
            near = np.flatnonzero(open_)
            if not len(near):
                continue
            ceiling, floor = ceiling[near], looked_up(low, block.cells[:, near])
            may = np.zeros((len(windows), len(near)), bool)
            for w, (least, most) in enumerate(windows):
                may[w] = (ceiling >= least) & (floor <= most)
                surely = floor[(floor >= least) & (ceiling <= most)]
                if len(surely) > k:
                    may[w] &= ceiling >= np.partition(surely, len(surely) - k)[-k]
            some = may.any(axis=0)
            near, may = near[some], may[:, some]
            score = block.x[near] @ q
            for w, (least, most) in enumerate(windows):
                inside = np.flatnonzero(may[w] & (score >= least) & (score <= most))
                for i in inside[block.best(near[inside], score[inside], k)]:
                    out.append((anchor, mark, ids[w], marks[w], scores[w], block.ids[near[i]], block.marks[near[i]], score[i]))
        return _table(out, _FOUND)

    return solve


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    names = [c.split()[0] for c in ddl.split(", ")]
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.table({n: pa.array(np.array(c, np.int64)) for n, c in zip(names, columns)})


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each key by score, then id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "mark")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low_share: int = 80, high_share: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of (vec_id, embedding, label).

    Anchors are rows whose id is divisible by ``every``; scores are inner products of floor(256 x).  A row with the
    anchor's id is neither its positive nor its negative.  Rows with a null id or label, and vectors that are null,
    empty, of another length than most, or hold null or non-finite components take no part.  Rows that repeat id,
    label and vector count once; an id with several vectors or labels is as many rows.  An anchor without another
    row of its label, and a positive whose window holds no row, give no rows; a positive of negative score has an
    empty window.  Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole(F.col("vec")))
    length = common_length(rows)
    rows = rows.where(F.size("vec") == length).withColumn("vec", quantized(F.col("vec"), length))
    rows = materialize(rows.withColumn("mark", F.xxhash64("label", "vec")).dropDuplicates(["vec_id", "mark", "label", "vec"]), "negatives-rows")
    is_anchor = F.col("vec_id") % every == 0
    total, asked = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    if not asked:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    cells = fitted(rows)
    file = materialize(rows.mapInArrow(_approximated(cells), _ROWS), "negatives-cells")
    release(rows)
    row_blocks, anchor_blocks = -(-total // BLOCK_ROWS), -(-asked // BLOCK_ANCHORS)
    place = lambda salt, n: F.pmod(F.xxhash64("vec_id", "mark", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = file.withColumn("block", place(1, row_blocks)).withColumn("anchors", each(anchor_blocks)).groupBy("anchors", "block")

    def met(anchors: DataFrame, solve, schema: str) -> DataFrame:
        sent = anchors.withColumn("anchors", place(2, anchor_blocks)).withColumn("block", each(row_blocks))
        return sent.groupBy("anchors", "block").cogroup(dealt).applyInArrow(solve, schema)

    anchors = file.where(is_anchor).drop("cells")
    best = materialize(_first(met(anchors, _positives(cells, positives), _FIRST), ["anchor_id", "anchor_mark"], positives), "negatives-positives")
    lists = best.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_mark").alias("mark")).agg(F.collect_list(F.struct("vec_id", "mark", "score")).alias("p"))
    lists = lists.select("vec_id", "mark", *(F.col(f"p.{c}").alias(f"positive_{c.removeprefix('vec_')}s") for c in ("vec_id", "mark", "score")))
    asking = materialize(anchors.join(lists, ["vec_id", "mark"]), "negatives-asking")
    found = met(asking, _negatives(cells, negatives, low_share, high_share), _FOUND)
    kept = _first(found, ["anchor_id", "anchor_mark", "positive_id", "positive_mark"], negatives)
    return kept.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
