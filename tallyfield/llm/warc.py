"""Web archives: a deterministic sharded WARC writer and a reader that checks every digest.

Records are sorted by id over shards whose boundaries come from a sample that any layout of the rows draws
alike, so the same records give the same files.  A task writes its shard's records in order, each a gzip
member of its own, and begins a new file once the open one has ``file_bytes`` compressed bytes.  Files get
temporary names that no other attempt uses; the rows that Spark commits to the manifest name the attempts
that count, those files are then renamed, and readers go by the manifest alone.  An attempt that was lost
leaves only files that nothing names.

Equal payloads of ``REVISIT_BYTES`` or more are stored once: the record with the largest id is a response
and the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import materialize, scratch_path, slices

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
#: Payload bytes of a shard, about, and the fewest and most shards.
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 256 << 20, 48, 8192
SAMPLE_KEYS = 20_000
#: The date of every record whose input has none, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
_NULL_ID = -(1 << 63)
_CRLF = b"\r\n"
_MANIFEST = "shard int, file string, temporary string, records long, compressed_bytes long"


def _digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _to_base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _urn(record_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}/{digest}')}>"


def record(record_id: int | None, uri: str | None, payload: bytes, payload_bytes: int, digest: str, revisits: int | None | bool = False, date: str = DATE) -> bytes:
    """One WARC record.  ``revisits`` is False for a response, else the id of the record that holds the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block = http if revisits is not False else http + payload
    target = "".join(c for c in uri or "" if c >= " ") or "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if revisits is False else 'revisit'}",
        f"WARC-Record-ID: {_urn(record_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_to_base32(digest)}",
        f"WARC-Block-Digest: {_digest32(block)}",
        f"X-Source-Record: {'' if record_id is None else record_id}",
    ]
    if revisits is not False:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(revisits, digest)}", f"X-Refers-To-Source-Record: {'' if revisits is None else revisits}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + _CRLF * 2 + block + _CRLF * 2


def parse_record(data: bytes) -> dict:
    """The headers and the payload of one record; raises if a length or digest does not hold."""
    head, _, rest = data.partition(_CRLF * 2)
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    length = int(fields["content-length"])
    block = rest[:length]
    if version != "WARC/1.1" or rest[length:] != _CRLF * 2 or fields["warc-block-digest"] != _digest32(block):
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    http, _, payload = block.partition(_CRLF * 2)
    whole = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    stored = fields["warc-type"] == "response"
    if stored and (len(payload) != whole or fields["warc-payload-digest"] != _digest32(payload)):
        raise ValueError(f"damaged payload {fields.get('warc-record-id')}")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {
        "record_id": number("x-source-record"),
        "uri": fields["warc-target-uri"],
        "record_type": fields["warc-type"],
        "refers_to": number("x-refers-to-source-record"),
        "payload_bytes": whole,
        "payload_digest": base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(),
        "payload": payload if stored else None,
    }


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file-like object, one by one."""
    inflate, out, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(size)):
        out.append(inflate.decompress(data))
        data = b""
        if inflate.eof:
            yield b"".join(out)
            inflate, out, data = zlib.decompressobj(31), [], inflate.unused_data
    if any(out):
        raise ValueError("the file ends inside a record")


class _Roller:
    """The files of one shard: an open one that is closed at ``file_bytes``, and rows for the manifest."""

    def __init__(self, directory: str, shard: int, file_bytes: int):
        self.files, self.top = pafs.FileSystem.from_uri(directory)
        self.shard, self.file_bytes, self.sink, self.number, self.rows = shard, file_bytes, None, 0, []

    def write(self, data: bytes) -> None:
        if self.sink is None:
            name = f"part-of-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.open = {"shard": self.shard, "file": f"shard-{self.shard:05d}-{self.number:05d}.warc.gz", "temporary": f".tmp-{uuid.uuid4().hex}-{name}", "records": 0, "compressed_bytes": 0}
            self.sink = self.files.open_output_stream(f"{self.top}/{self.open['temporary']}", compression=None)
            self.number += 1
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = deflate.compress(data) + deflate.flush()
        self.sink.write(packed)
        self.open["records"] += 1
        self.open["compressed_bytes"] += len(packed)
        if self.open["compressed_bytes"] >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.rows.append(self.open)
            self.sink = None


def _write_shards(directory: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, seen, directive, rows = None, None, {}, []
        for batch in slices(batches, "payload", 8 << 20):
            for r in batch.to_pylist():
                if roller is None or roller.shard != r["shard"]:
                    if roller:
                        roller.close()
                        rows += roller.rows
                    roller = _Roller(directory, r["shard"], file_bytes)
                key = (r["record_id"], r["digest"], r["payload_bytes"])
                if r["kind"] == 0:  # comes just before the records it is about
                    directive = {key: r["refers_to"]}
                    continue
                again = key == seen and r["payload_bytes"] >= REVISIT_BYTES
                seen = key
                revisits = directive[key] if key in directive else r["record_id"] if again else False
                roller.write(record(r["record_id"], r["uri"], r["payload"], r["payload_bytes"], r["digest"], revisits))
        if roller:
            roller.close()
            rows += roller.rows
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), ("file", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("compressed_bytes", pa.int64())]))

    return write


def _rename(directory: str):
    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            for r in batch.to_pylist():
                if files.get_file_info(f"{top}/{r['temporary']}").type != pafs.FileType.NotFound:
                    files.move(f"{top}/{r['temporary']}", f"{top}/{r['file']}")
                if files.get_file_info(f"{top}/{r['file']}").size != r["compressed_bytes"]:
                    raise OSError(f"{r['file']} is not as its manifest says")
            yield batch.select(["shard", "file", "records", "compressed_bytes"])

    return renamed


def _boundaries(keyed: DataFrame, total: int, shards: int) -> list[int]:
    """Quantiles of the ids by payload bytes, from a sample that depends on ids and sizes only."""
    chance = (F.col("payload_bytes") + 500) * F.lit(SAMPLE_KEYS / max(total, 1))
    dice = F.pmod(F.xxhash64("record_id", "digest"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keyed.where(F.col("record_id").isNotNull() & (dice < chance)).groupBy("record_id").agg(F.sum(F.greatest(chance, F.lit(1.0))).alias("w"))
    rows = sorted(tuple(r) for r in drawn.collect())
    if not rows or shards < 2:
        return []
    weight = np.cumsum([w for _, w in rows])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, shards) / shards)
    return sorted({rows[i][0] for i in at})


def write_warc(records: DataFrame, directory: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive (record_id long, uri string, payload binary) under ``directory``; returns the manifest.

    The manifest (shard, file, records, compressed_bytes) is also written there, under ``manifest``.  Null
    payloads are stored as empty ones, null ids come first in the first shard, null uris become about:blank.
    Rows with equal id and payload are one response and revisits of it.  Other columns are left out.
    """
    spark = records.sparkSession
    files, top = pafs.FileSystem.from_uri(directory)
    files.create_dir(top, recursive=True)
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    rows = records.select(F.col("record_id").cast("long").alias("record_id"), "uri", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    keyed = materialize(rows.select("record_id", "digest", "payload_bytes"), "warc-keys")
    total = keyed.agg(F.sum(F.col("payload_bytes") + 500)).first()[0] or 0
    shards = int(min(MOST_SHARDS, max(LEAST_SHARDS, -(-total // SHARD_BYTES))))
    cuts = np.array(_boundaries(keyed, total, shards), np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), side="left").astype(np.int32))

    large = keyed.where(F.col("payload_bytes") >= REVISIT_BYTES)
    copies = large.groupBy("digest", "payload_bytes").agg(F.max("record_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = materialize(copies, "warc-copies")
    told = large.join(copies, ["digest", "payload_bytes"]).where("record_id < refers_to or (record_id is null and refers_to is not null)")
    told = told.select("record_id", F.lit(None).cast("string").alias("uri"), F.lit(None).cast("binary").alias("payload"), "digest", "payload_bytes", "refers_to", F.lit(0).alias("kind"))
    every = told.unionByName(rows.withColumns({"refers_to": F.lit(None).cast("long"), "kind": F.lit(1)}))
    every = every.withColumn("shard", shard_of(F.coalesce("record_id", F.lit(_NULL_ID))))
    dealt = every.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("record_id"), "digest", "payload_bytes", "kind", "uri")
    written = materialize(dealt.mapInArrow(_write_shards(directory, file_bytes), _MANIFEST), "warc-written")
    written.mapInArrow(_rename(directory), "shard int, file string, records long, compressed_bytes long").write.parquet(f"{directory}/manifest")
    return spark.read.parquet(f"{directory}/manifest")


def _read_files(directory: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pafs.FileSystem.from_uri(directory)
        schema = pa.schema([("record_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string())])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for data in members(stream):
                        row = parse_record(data) | {"file": name}
                        held += len(row["payload"] or b"")
                        rows.append(row if with_payload else row | {"payload": None})
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_warc(spark: SparkSession, directory: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the files in the manifest: record_id, uri, record_type, refers_to,
    payload_bytes, payload_digest (hex), payload (of responses) and file.  Every length and digest is checked."""
    manifest = spark.read.parquet(f"{directory}/manifest")
    n = max(1, manifest.count())
    files = manifest.select("file").repartition(min(n, MOST_SHARDS))
    return files.mapInArrow(_read_files(directory, with_payload), "record_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write (page_id, url, html) to a fresh archive in the shared folder and read it back."""
    spark = pages.sparkSession
    directory = scratch_path(spark, "warc")
    directory = directory if "://" in directory else f"file://{directory}"
    write_warc(pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload")), directory)
    return read_warc(spark, directory, with_payload=False)
