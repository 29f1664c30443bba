"""Best-fit packing of tokenized documents into sequences, with certified bin counts.

Pieces are dealt out to groups and each group is packed by best-fit decreasing.  Dual-feasible functions
give a lower bound on the bins that a group needs.  A group that meets its bound is done.  A group with a
gap keeps its full bins and gives the pieces of its other bins to an exchange: the loose pieces of all
groups are dealt out anew, packed and certified again, until no group has a gap, one group is left, or
``ROUNDS`` rounds are over.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import byte_texts, in_parts, materialize, trimmed
from tallyfield.llm.encoder import word_encoder

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 25_000
ROUNDS = 4
CHUNK_BYTES = 2 << 20
#: A bin with this share of its room or more in use stays as it is when its group goes to the exchange.
TIGHT = 0.998


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(path: str, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, uids = word_encoder(path), count(TaskContext.get().partitionId() << 36)

        def pieces_of(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, own = encoder.ids_of(byte_texts(part))
            ids, own = np.insert(ids, np.cumsum(own), END_ID), own + 1
            pieces = -(-own // capacity)
            of, n = np.repeat(np.arange(len(own)), pieces), int(pieces.sum())
            piece = np.arange(n) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(capacity, own[of] - piece * capacity)
            ends = np.cumsum(length)
            view = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(of)), pa.array(list(islice(uids, n)), pa.int64()), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "uid", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), ids.view(np.int32))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

        yield from in_parts(batches, "text", CHUNK_BYTES, pieces_of)

    return cut


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, uid, piece, start, length, ids_crc32 (and ids) of every piece of every document, written once.

    Every text gets its ids and then ``END_ID``, so a null or empty text is one piece of length one.  Only
    texts of more than ``capacity`` ids are cut.  ``uid`` tells repeated rows apart.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return materialize(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, with_ids), schema), "pieces")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, longest first into the fullest bin it fits (ties: in order)."""
    bins = np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, b, used = capacity, used, used + 1
        bins[i] = b
        room -= n
        if room:
            open_bins[room].append(b)
            mask |= 1 << room
    return bins


def bins_needed(lengths: np.ndarray, capacity: int, most: int = 64) -> int:
    """A lower bound on the bins for ``lengths``: the best of two families of dual-feasible functions.

    One rounds each size to multiples of 1/k (sizes that are such multiples stay as they are); the other
    counts sizes over ``capacity - a`` whole, drops those under ``a`` and leaves the rest.  A function is
    dual feasible if sizes that fit one bin keep a sum of one at most, so its total needs as many bins.
    """
    return _bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity, most)


def _bound(n: np.ndarray, capacity: int, most: int = 64) -> int:
    """:func:`bins_needed` from the number of pieces of each length."""
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * size).sum()) // capacity)
    for k in range(1, most):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k, k + 1) * (scaled // capacity)  # in units of 1 / (k (k + 1))
        best = max(best, -(-int((n * value).sum()) // (k * (k + 1))))
    counts, sums = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * size)))
    a = np.arange(1, capacity // 2 + 1)
    large = counts[-1] - counts[capacity - a + 1]
    middle = sums[capacity - a + 1] - sums[a]
    return max(best, int((large + -(-middle // capacity)).max()) if len(a) else 0)


def _pack_group(capacity: int, ratio: float, last: bool):
    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        used = np.bincount(bins, lengths).astype(np.int64)
        loose = np.zeros(len(frame), bool)
        fair = math.ceil(ratio * lengths.sum() / capacity - 1e-9)
        if not last and len(used) > min(fair, bins_needed(lengths, capacity)):
            loose = (used < TIGHT * capacity)[bins]
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        begin = before[np.searchsorted(bins[order], np.arange(len(used)))]
        offset = np.empty(len(frame), np.int64)
        offset[order] = before - begin[bins[order]]
        return frame.assign(bin=bins, offset=offset, loose=loose)

    return packed


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """sequence_id and offset of every piece (uid, length): as few sequences of ``capacity`` as can be shown.

    ``sequence_id`` joins round, group and bin.  Groups hold about ``group_pieces``, in every round.  A group
    has a gap if it has more bins than its own bound, or than its share of the bound for all pieces: then
    its pieces fit those of other groups better than one another.  No pieces give no rows.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    volume = int((counts * np.arange(capacity + 1)).sum())
    ratio = _bound(counts, capacity) * capacity / max(volume, 1)
    n, todo, parts = int(counts.sum()), pieces.select("uid", "length"), []
    for level in range(ROUNDS):
        groups = max(1, -(-n // group_pieces))
        last = groups == 1 or level == ROUNDS - 1
        grouped = todo.withColumn("group", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
        done = grouped.groupBy("group").applyInPandas(trimmed(_pack_group(capacity, ratio, last)), "uid long, length long, group long, bin long, offset long, loose boolean")
        done = materialize(done, f"packed{level}")
        number = (F.lit(level).cast("long") * (1 << 58)) + F.col("group") * (1 << 32) + F.col("bin")
        parts.append(done.where("not loose").select("uid", number.alias("sequence_id"), "offset"))
        todo = done.where("loose").select("uid", "length")
        if last or not (n := todo.count()):
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document of (doc_id, text) with its sequence_id and its offset there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).  Null ids are kept,
    repeated rows are separate documents, other columns are left out, an empty table gives no rows.
    """
    pieces = tokenized_pieces(docs, tokenizer, capacity, with_ids)
    return pieces.join(pack(pieces, capacity), "uid").drop("uid")
