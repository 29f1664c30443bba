"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.session import release, scratch_dir, scratch_path  # noqa: F401  (operators take them from here)

#: A word: a run of anything but ASCII white space.  ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of words a Python worker remembers, with what an entry takes beside its word, before it forgets them all; a
#: word longer than a share of that is not remembered.  Bounds a worker's memory, not the result.
REMEMBERED_BYTES, ENTRY_BYTES, LONGEST_SHARE = 16 << 20, 160, 64

_MASK = (1 << 64) - 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and lost executors cost nothing.

    The shuffle files of the finished write are let go at once, so that disk holds one step's at a time.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def word_count(text: Column) -> Column:
    """Words in a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes in each; a longer value stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def in_parts(batches: Iterator[pa.RecordBatch], column: str, limit: int, work) -> Iterator[pa.RecordBatch]:
    """What ``work`` yields for each slice; a slice's arrays are gone before the next is worked on.

    Workers outlive their tasks, so what a task has freed is given back to the system at its end.
    """
    try:
        for part in slices(batches, column, limit):
            yield from work(part)
            del part
    finally:
        trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def trimmed(function):
    """``function`` of a group, which gives back what the group took before the next one comes."""

    @wraps(function)
    def work(group):
        out = function(group)
        trim()
        return out

    return work


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch in UTF-8, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


class Remember(dict):
    """``remember[word]`` computes a value once per distinct word, within a bound on the bytes kept."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.held = compute, 0

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= REMEMBERED_BYTES // LONGEST_SHARE:
            self.held += len(word) + ENTRY_BYTES
            if self.held > REMEMBERED_BYTES:
                self.clear()
                self.held = len(word) + ENTRY_BYTES
            self[word] = value
        return value


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of all texts in order, and the number of words of each text."""
    parts = [x.split() for x in texts]
    return list(chain.from_iterable(parts)), np.fromiter(map(len, parts), np.int64, len(parts))


def word_hashes(words: list[bytes], remember: Remember) -> np.ndarray:
    return np.fromiter(map(remember.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (the finisher of splitmix64)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp value of every window of ``width`` consecutive hashes, modulo 2**64.

    Element i covers i .. i+width-1; values whose window would leave the array are not returned.
    Windows of powers of two are doubled and then joined, which gives the same polynomial as sliding.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, covered, power, size = None, 0, hashes, 1
    rest = width
    while rest:
        if rest & 1:
            if total is None:
                total, covered = power, size
            else:
                total = total[: len(hashes) - covered - size + 1] * np.uint64(pow(base, size, 1 << 64)) + power[covered : covered + len(hashes) - covered - size + 1]
                covered += size
        rest >>= 1
        if rest:
            power = power[: len(power) - size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
            size *= 2
    return total[:n]


def window_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: each window's text, its place in the whole and its place in its text."""
    windows = np.maximum(counts - width + 1, 0)
    of = np.repeat(np.arange(len(counts)), windows)
    local = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    return of, local + np.repeat(np.cumsum(counts) - counts, windows), local
