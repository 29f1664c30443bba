"""Substring deduplication: every repeated passage of ``width`` words stays at its first place only.

Every window of ``width`` consecutive words gets two Rabin-Karp hashes, over independent hashes of its words.
Windows are dealt out to buckets and counted there; of a window that occurs more than once all but the first
(smallest doc_id, then smallest start) are repeats.  Repeated windows of a document merge into maximal
intervals of words, and these are removed.

The first hash travels whole, 64 bits.  The second picks the bucket and sends 16 further bits along, so that
windows are told apart by 80 bits and those of the bucket, whose number grows with the input.  Of w windows in b
buckets about w**2 / (2**81 b) pairs that differ are expected to agree in all of them: 2e-9 for 30 GB of Parquet
(8e9 windows, 12,000 buckets), some 1e-5 for 100 TB.

Windows travel packed: a row holds the windows of one bucket from a few megabytes of text.  Before they
travel, a window that repeats within that text stays at its first place only and the others are known to be
repeats already, so that a passage found in a third of all documents sends one window for every few
megabytes, not one for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyfield.llm.common import Remember, byte_texts, in_parts, materialize, mix, rolling, split_words, trimmed, window_starts

WIDTH = 20
BASE, SECOND_BASE = 0x5851F42D4C957F2D, 0x2127599BF4325C37
#: Bytes of text whose windows are packed together.
CHUNK_BYTES = 4 << 20
#: Bytes of text whose words are split, or cut, at once.
HASHED_BYTES = 1 << 20
#: Bytes of text for each bucket (its windows are counted in one task's memory), and buckets for each task.
BUCKET_BYTES, TASK_BUCKETS = 4 << 20, 4
_NULL_ID = -(1 << 63)

_PACKED = "bucket int, chunk long, first_id long, docs int, idx binary, ids binary, counts binary, starts binary, hashes binary, tags binary, marks binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("first_id", pa.int64()), ("docs", pa.int32()), *((c, pa.binary()) for c in ("idx", "ids", "counts", "starts", "hashes", "tags", "marks"))])
_FOUND_ARROW = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("ids", "marks", "idx", "starts"))])
_SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _pack(values: np.ndarray) -> bytes:
    """Unsigned values in the narrowest width that holds them all."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64)


def _repeats(hashes: np.ndarray, tags: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a window, known by hash and tag, also starts earlier: at a smaller (id, start)."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) < 2:
        return out
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    often = np.sort(order[np.concatenate(([False], same)) | np.concatenate((same, [False]))])
    if len(often):
        order = often[np.lexsort((starts[often], ids[often], tags[often], hashes[often]))]
        h, t = hashes[order], tags[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])))
        first = order[new][np.cumsum(new) - 1]
        out[order] = (ids[order] != ids[first]) | (starts[order] != starts[first])
    return out


def _two_hashes(word: bytes) -> bytes:
    return xxhash.xxh3_128_digest(word)


def _word_hashes(texts: list[bytes], remember: Remember) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of all words of all texts as a (words, 2) array, and the words of each text.

    Words are let go every ``HASHED_BYTES`` of text, so that those of a chunk are never all there at once.
    """
    parts, counts, start, size = [], [np.zeros(0, np.int64)], 0, 0
    for stop, text in enumerate(texts, 1):
        size += len(text)
        if size >= HASHED_BYTES or stop == len(texts):
            words, own = split_words(texts[start:stop])
            parts.append(b"".join(map(remember.__getitem__, words)))
            counts.append(own)
            start, size = stop, 0
    return np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2), np.concatenate(counts)


def _windows(both: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of every window, in the order of their first words, over all words laid end to end."""
    return mix(rolling(both[:, 0], width, BASE)), mix(rolling(both[:, 1], width, SECOND_BASE), 1)


def _pack_windows(width: int, buckets: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        remember = Remember(_two_hashes)
        chunks = count(TaskContext.get().partitionId() << 32)

        def windows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, chunk = part.column("doc_id").fill_null(_NULL_ID).to_numpy(), next(chunks)
            order = np.argsort(ids, kind="stable")
            texts = byte_texts(part)
            both, counts = _word_hashes([texts[i] for i in order], remember)
            del texts
            ids, marks = ids[order], part.column("text_hash").to_numpy()[order]
            of, at, starts = window_starts(counts, width)
            if not len(of):
                return
            hashes, second = (h[at] for h in _windows(both, width))
            del both, at
            tags = (second & np.uint64(0xFFFF)).astype(np.uint16)
            again = _repeats(hashes, tags, ids[of], starts)
            gone, kept = np.flatnonzero(again), np.flatnonzero(~again)
            # what is decided here goes to the chunk's own row, with the documents' ids and marks
            yield pa.RecordBatch.from_pylist(
                [{"bucket": xxhash.xxh3_64_intdigest(str(chunk)) % buckets, "chunk": chunk, "first_id": None, "docs": len(ids), "idx": of[gone].astype(np.uint32).tobytes(), "ids": ids.tobytes(), "counts": None, "starts": starts[gone].astype(np.uint32).tobytes(), "hashes": None, "tags": None, "marks": marks.tobytes()}],
                _PACKED_ARROW,
            )
            bucket = ((second[kept] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            kept, bucket = kept[order], bucket[order]
            begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(kept) else np.zeros(0, int)
            rows = []
            for b, lo, hi in zip(bucket[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(kept)], strict=True):
                own = kept[lo:hi]
                doc, per = np.unique(of[own], return_counts=True)
                steps = np.diff(ids[doc].astype(np.uint64), prepend=ids[doc[:1]].astype(np.uint64))
                rows.append({"bucket": b, "chunk": chunk, "first_id": int(ids[doc[0]]), "docs": len(doc), "idx": _pack(doc), "ids": _pack(steps), "counts": _pack(per), "starts": _pack(starts[own]), "hashes": hashes[own].tobytes(), "tags": tags[own].tobytes(), "marks": None})
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, _PACKED_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _PACKED_ARROW)

        yield from in_parts(batches, "text", CHUNK_BYTES, windows)

    return packed


def _count_bucket(table: pa.Table) -> pa.Table:
    """Of one bucket's windows, those that repeat, by chunk; rows that a chunk sends itself pass through."""
    out = {c: [] for c in _FOUND_ARROW.names}
    hashes, tags, ids, starts, of, chunks = [], [], [], [], [], []
    for r in table.to_batches():
        for row in r.to_pylist():
            if row["first_id"] is None:
                for c in out:
                    out[c].append(row[c])
                continue
            h, n = np.frombuffer(row["hashes"], np.uint64), row["docs"]
            doc, per = _unpack(row["idx"], n), _unpack(row["counts"], n)
            own = np.cumsum(_unpack(row["ids"], n)) + row["first_id"]
            hashes.append(h)
            tags.append(np.frombuffer(row["tags"], np.uint16))
            ids.append(np.repeat(own, per))
            starts.append(_unpack(row["starts"], len(h)).astype(np.uint32))
            of.append(np.repeat(doc, per).astype(np.uint32))
            chunks.append(row["chunk"])
    if hashes:
        edges = np.cumsum([0, *map(len, hashes)])
        again = _repeats(*map(np.concatenate, (hashes, tags, ids, starts)))
        for k, chunk in enumerate(chunks):
            mine = again[edges[k] : edges[k + 1]]
            if mine.any():
                for c, v in (("chunk", chunk), ("ids", None), ("marks", None), ("idx", of[k][mine].tobytes()), ("starts", starts[k][mine].tobytes())):
                    out[c].append(v)
    return pa.table(out, _FOUND_ARROW)


def _merge_chunk(width: int):
    def merged(table: pa.Table) -> pa.Table:
        """Maximal intervals of the documents of one chunk from the starts of its repeated windows."""
        own = next(r for b in table.to_batches() for r in b.to_pylist() if r["ids"] is not None)
        idx, starts = (np.frombuffer(b"".join(x for x in table.column(c).to_pylist()), np.uint32).astype(np.int64) for c in ("idx", "starts"))
        order = np.lexsort((starts, idx))
        idx, starts = idx[order], starts[order]
        new = np.ones(len(idx), bool)
        new[1:] = (idx[1:] != idx[:-1]) | (starts[1:] > starts[:-1] + width)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(idx))[: len(begin)] - 1
        doc, per = np.unique(idx[begin], return_counts=True)
        offsets = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, x.astype(np.int32)) for x in (starts[begin], starts[last] + width)]
        ids, marks = np.frombuffer(own["ids"], np.int64)[doc], np.frombuffer(own["marks"], np.int64)[doc]
        return pa.table([pa.array(ids), pa.array(marks), *lists], schema=_SPANS_ARROW)

    return merged


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, begins, ends: the word intervals to remove from each document that has any.

    A null id counts as smaller than all others and comes back as the smallest long.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    tasks = -(-buckets // TASK_BUCKETS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    packed = rows.mapInArrow(_pack_windows(width, buckets), _PACKED)
    found = packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(trimmed(_count_bucket), "chunk long, ids binary, marks binary, idx binary, starts binary")
    spans = found.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(trimmed(_merge_chunk(width)), "doc_id long, text_hash long, begins array<int>, ends array<int>")
    return materialize(spans, "repeated-spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def without(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total, gone, kept = [], [], []
        spans = zip(byte_texts(batch), batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True)
        for text, begins, ends in spans:
            words = text.split()
            total.append(len(words))
            if begins:
                left, at = [], 0
                for b, e in zip(begins, ends, strict=True):
                    left += words[at:b]
                    at = e
                words = left + words[at:]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        own = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("begins", "ends")]
        made = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*(c for _, c in own), *made], [*(n for n, _ in own), "n_words", "n_removed", "kept_text"])

    yield from in_parts(batches, "text", HASHED_BYTES, without)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns of ``docs`` with n_words, n_removed and kept_text (the kept words joined by one space).

    Words are runs of anything but ASCII white space.  A word goes if a window of ``width`` words that
    covers it also starts earlier (smaller doc_id, or the same id and a smaller start); all windows are
    judged on the input.  Null and empty texts have no words and an empty kept_text; texts shorter than the
    window keep everything.  A null id counts as the smallest.  Rows that share id and text are judged as
    one, so an exact repetition of a row does not remove itself.  An empty table gives no rows.  Columns of
    ``docs`` named like the new ones are replaced.
    """
    spans = repeated_spans(docs, width)
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text", "begins", "ends", "text_hash")]
    near = docs.select(*kept, F.xxhash64("text").alias("__hash"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("__id"))
    spans = spans.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "begins", "ends")
    joined = near.join(spans.hint("shuffle_hash"), ["__id", "__hash"], "left").drop("__id", "__hash")
    shaped = joined.select(*kept, "begins", "ends")
    schema = StructType([*(docs.schema[c] for c in kept), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    return shaped.mapInArrow(_cut, schema)
