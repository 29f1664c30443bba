"""Compressing vectors to one short code for each part, with a codebook for each part.

A codebook is a few dozen entries, so its kd-tree is broadcast in every round.  A task walks the trees with all
rows of an Arrow batch at once: rows go down on their side of a split first, and come to the other side while its
box is not farther than their best entry.  Boxes at exactly the best distance are opened as well, so among equal
entries the lowest index is found.  Tasks add up what each entry was given; Spark sums those integers, and the
driver sees one number for each component of a codebook.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyfield.llm.common import materialize, release
from tallyfield.llm.vectors import common_length, matrix, whole

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LEAF_ENTRIES = 8
#: Sums by label are broadcast up to as many labels (16 bytes each); beyond, rows meet them in salted groups.
MOST_LABELS, SALTS = 100_000, 16
_FAR = np.iinfo(np.int64).max


@dataclass
class Node:
    """A box around entries: either a leaf with their indexes, or split at ``value`` of dimension ``axis``."""

    low: np.ndarray
    high: np.ndarray
    held: np.ndarray
    axis: int = 0
    value: int = 0
    sides: tuple = ()


def grown(entries: np.ndarray, held: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook: the widest dimension is halved until few entries, or only equal ones, are left."""
    held = np.arange(len(entries)) if held is None else held
    x = entries[held]
    node = Node(x.min(axis=0), x.max(axis=0), held)
    axis = int(np.argmax(node.high - node.low))
    if len(held) > LEAF_ENTRIES and node.high[axis] > node.low[axis]:
        order = np.sort(x[:, axis])
        value = int(order[len(order) // 2])
        if value == order[0]:
            value = int(order[np.searchsorted(order, value, side="right")])
        left = x[:, axis] < value
        node.axis, node.value, node.sides = axis, value, (grown(entries, held[left]), grown(entries, held[~left]))
    return node


class KdTree:
    def __init__(self, entries: np.ndarray):
        self.entries, self.root = entries, grown(entries)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the nearest entry (ties: the lowest index) and its squared distance."""
        best, index = np.full(len(x), _FAR), np.full(len(x), len(self.entries))
        self._visit(self.root, np.arange(len(x)), x, best, index)
        return index, best

    def _visit(self, node: Node, rows: np.ndarray, x, best, index) -> None:
        at = x[rows]
        outside = np.maximum(node.low - at, 0) + np.maximum(at - node.high, 0)
        rows = rows[(outside**2).sum(axis=1) <= best[rows]]
        if not len(rows):
            return
        if node.sides:
            left, right = node.sides
            below = x[rows, node.axis] < node.value
            for first, second, part in ((left, right, rows[below]), (right, left, rows[~below])):
                self._visit(first, part, x, best, index)
                self._visit(second, part, x, best, index)
            return
        apart = ((x[rows][:, None, :] - self.entries[node.held][None]) ** 2).sum(axis=2)
        which = apart.argmin(axis=1)
        found, entry = apart[np.arange(len(rows)), which], node.held[which]
        closer = (found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))
        best[rows[closer]], index[rows[closer]] = found[closer], entry[closer]


def _parts(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as a (parts, rows, components) array."""
    return matrix(batch.column("vec"), np.int64).reshape(batch.num_rows, PARTS, width).transpose(1, 0, 2)


def _summed(trees, width: int):
    """For each task: how many rows every entry was given, and the sum of each of their components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(trees.value[0].entries)
        sums, counts = np.zeros((PARTS, size, width), np.int64), np.zeros((PARTS, size), np.int64)
        for batch in batches:
            for part, x in enumerate(_parts(batch, width) if batch.num_rows else ()):
                index, _ = trees.value[part].nearest(x)
                np.add.at(sums[part], index, x)
                counts[part] += np.bincount(index, minlength=size)
        part, entry, place = np.nonzero(np.repeat(counts[:, :, None] > 0, width, axis=2))
        columns = (part.astype(np.int32), entry.astype(np.int32), place.astype(np.int32), sums[part, entry, place], counts[part, entry])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "place", "total", "rows"])

    return work


def _coded(trees, width: int):
    """vec_id, label, code, error of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [trees.value[part].nearest(x) for part, x in enumerate(_parts(batch, width))]
                codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
                error = np.sum([apart for _, apart in found], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return work


def quantized(vector: Column, length: int) -> Column:
    """floor(256 x) of each component, and zeros up to a multiple of the number of parts.

    Components are held within bounds that keep a sum of squared distances inside 64 bits; they are beyond a
    hundred thousand for vectors of up to 1,024 components.
    """
    limit = math.isqrt((1 << 58) // max(1, -(-length // PARTS))) // 2
    inside = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), F.lit(float(SCALE)) * x.cast("double")))).cast("long"))
    return F.concat(inside, F.array_repeat(F.lit(0).cast("long"), -length % PARTS))


def _start(rows: DataFrame) -> np.ndarray:
    """The vectors of the smallest ids, ascending: at most ``ENTRIES`` rows come to the driver."""
    ids = [r["vec_id"] for r in rows.select("vec_id").where(F.col("vec_id").isNotNull()).distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    first = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy("vec_id")
    return np.array([r["vec"] for r in first.collect()], np.int64)


def trained(spark: SparkSession, rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks as a (parts, entries, components) array after ``rounds`` of assignment and averaging."""
    start = _start(rows)
    width = start.shape[1] // PARTS
    books = start.reshape(len(start), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
        sums = rows.select("vec").mapInArrow(_summed(trees, width), "part int, entry int, place int, total long, rows long")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).collect():  # a row for each component of a codebook
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["rows"]
        trees.unpersist()
    return books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors summed over equal labels (nulls are equal); null where a sum leaves 64 bits."""
    sums = materialize(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "codes-labels").withColumnRenamed("label", "of")
    if sums.count() <= MOST_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    salted = sums.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")), "left").drop("of", "salt", "at")


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for the rows of (vec_id, embedding, label).

    Rows whose vector is null, empty, of another length than most, or holds null or non-finite components are left
    out.  Repeated rows are coded each; of an id with several vectors the smallest one starts the codebooks, and
    null ids start none.  With fewer than ``ENTRIES`` ids the codebooks are as short; lengths that the number of
    parts does not divide are filled up with zeros.  Other columns are ignored.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vec")).where(whole(F.col("vec")))
    length = common_length(rows)
    rows = materialize(rows.where(F.size("vec") == length).withColumn("vec", quantized(F.col("vec"), length)), "codes-rows")
    schema = StructType([StructField("vec_id", LongType()), rows.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    if rows.where(F.col("vec_id").isNotNull()).isEmpty():
        return spark.createDataFrame([], schema.add("label_error", LongType()).add("codebooks_sha256", StringType()))
    books = trained(spark, rows)
    trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
    coded = materialize(rows.mapInArrow(_coded(trees, books.shape[2]), schema), "codes-coded")
    trees.unpersist()
    release(rows)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest))
