"""A quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text's n-grams are its words, its pairs of neighbouring words, and the same over the words' shapes (runs
of upper case, lower case, digits and other signs); a word that follows itself has a pair of its own.  Each
is hashed to one of ``BUCKETS`` weights, and the score is the logistic of their mean: a sparse dot product
whose values are the n-grams' shares of the text.

Training reads a bounded sample of the labelled rows (``TRAIN_ROWS``, those with the smallest hash of their
id).  Their n-grams are hashed where the rows are; one task then updates the weights row after row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyfield.llm.common import Remember, byte_texts, in_parts, mix, split_words

BUCKETS = 1 << 18
TRAIN_ROWS = 8_192
EPOCHS = 4
CHUNK_BYTES = 1 << 20
#: Learning rate, its smoothing, and the two penalties of the update; values are shares scaled by SCALE.
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 1e-4, 1e-3, 8.0
_SIGNS = bytes(b"A"[0] if 65 <= b <= 90 else b"a"[0] if 97 <= b <= 122 or b >= 128 else b"0"[0] if 48 <= b <= 57 else b for b in range(256))
_AGAIN = re.compile(rb"(.)\1+", re.DOTALL)
_REPEAT, _KINDS = 0x51ED270B, 4


def _shape(word: bytes) -> bytes:
    """The whole word with a sign for each letter and digit, a repeated sign once; a mark for long words."""
    return _AGAIN.sub(rb"\1", word.translate(_SIGNS)) + (b"+" if len(word) > 24 else b"")


def _two_hashes(word: bytes) -> int:
    """32 bits for the word and 32 for its shape."""
    return (xxhash.xxh3_64_intdigest(word.lower()) & 0xFFFFFFFF) << 32 | xxhash.xxh3_64_intdigest(_shape(word)) & 0xFFFFFFFF


def ngram_buckets(texts: list[bytes], remember: Remember, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """For each word of each text its four n-grams, hashed, as a (words, 4) array; and the words of each text."""
    words, counts = split_words(texts)
    both = np.fromiter(map(remember.__getitem__, words), np.uint64, len(words))
    begins = np.zeros(len(words), bool)
    begins[(np.cumsum(counts) - counts)[counts > 0]] = True
    out = np.empty((len(words), _KINDS), np.int32)
    for k, values in enumerate((both >> np.uint64(32), both & np.uint64(0xFFFFFFFF))):
        before = np.concatenate((values[:1] * np.uint64(0), values[:-1]))
        pair = np.where(begins, np.uint64(1), mix(before, 31) ^ values)
        if k == 0:
            pair[(before == values) & ~begins] = np.uint64(_REPEAT)
        for j, v in enumerate((values, pair)):
            out[:, 2 * k + j] = (mix(v, 41 + 2 * k + j) % np.uint64(buckets - 1)).astype(np.int32) + 1
    return out, counts


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over (buckets, values, label) rows, in the order given, ``epochs`` times."""
    z, n = np.zeros(buckets), np.zeros(buckets)

    def weights(i):
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(epochs):
        for i, x, label in rows:
            w = weights(i)
            gap = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label
            g = gap * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(buckets))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray


def _hashed(buckets: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember = Remember(_two_hashes)

        def vectors(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            grams, counts = ngram_buckets(byte_texts(part), remember, buckets)
            ends, ids, values = np.cumsum(counts), [], []
            for a, b in zip(ends - counts, ends, strict=True):
                i, n = np.unique(grams[a:b], return_counts=True)
                ids.append(np.append(i, 0).astype(np.int32).tobytes())  # bucket 0 is the intercept
                values.append(np.append(SCALE * n / max(1, _KINDS * (b - a)), 1.0).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("turn"), part.column("label"), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["turn", "label", "ids", "vals"])

        yield from in_parts(batches, "text", CHUNK_BYTES, vectors)

    return hashed


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> QualityModel:
    """A model from (doc_id, text) and (doc_id, quality); labels that are null or not 0 or 1 take no part.

    At most ``rows`` labelled rows are read, those whose id's hash is smallest; a document that is labelled
    twice is read twice.  Without any labelled row all weights are zero and every score is one half.
    """
    chosen = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    chosen = chosen.withColumn("turn", F.xxhash64("doc_id", F.lit(5))).orderBy("turn", "doc_id", "label").limit(rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("turn", "label", "text")
    vectors = sample.mapInArrow(_hashed(buckets), "turn long, label int, ids binary, vals binary")

    def fit(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values(["turn", "label", "ids"], kind="stable")
        made = ftrl([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(np.float64), int(y)) for i, v, y in zip(frame["ids"], frame["vals"], frame["label"], strict=True)], buckets)
        return pa.table({"weights": pa.array([made.astype(np.float32).tobytes()], pa.binary())})

    fitted = vectors.groupBy().applyInArrow(fit, "weights binary").first()
    return QualityModel(np.frombuffer(fitted["weights"], np.float32).astype(np.float64) if fitted else np.zeros(buckets))


def _scored(weights: np.ndarray):
    buckets = len(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember = Remember(_two_hashes)

        def scores(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            grams, counts = ngram_buckets(byte_texts(part), remember, buckets)
            per_word = weights[grams].sum(axis=1)
            ends = np.concatenate(([0.0], np.cumsum(per_word)))[np.concatenate(([0], np.cumsum(counts)))]
            dots = SCALE * np.diff(ends) / np.maximum(_KINDS * counts, 1) + weights[0]
            score = 1 / (1 + np.exp(-np.clip(dots, -35, 35)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])

        yield from in_parts(batches, "text", CHUNK_BYTES, scores)

    return scored


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with a ``score`` from 0 to 1 of each whole text; null and empty texts get the intercept's.

    The score depends on the text alone.  A column of that name is replaced; an empty table gives no rows.
    """
    docs = docs.drop("score")
    return docs.mapInArrow(_scored(model.weights), StructType([*docs.schema, StructField("score", DoubleType())]))
