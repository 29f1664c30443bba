"""The quality query against a plain version: n-grams hashed one by one, weights in dictionaries, one update at a time."""

import collections
import math
import zlib

import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from tallyfield.llm.queries import op5_quality

MASK = (1 << 64) - 1
BUCKETS, EPOCHS, ALPHA, BETA, L1, L2, SCALE = 1 << 18, 4, 0.3, 1.0, 1e-4, 1e-3, 8.0


def spread(x, salt):
    x = (x + (salt + 1) * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def short_hash(word):
    return xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF


def shape(word):
    out = bytearray()
    for b in word:
        sign = ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
        if not out or out[-1] != sign:
            out.append(sign)
    return bytes(out) + (b"+" if len(word) > 24 else b"")


def features(text):
    """The share of each n-gram of a text, and the intercept."""
    found = (text or "").encode().split()
    grams = collections.Counter()
    for kind, values in enumerate(([short_hash(w.lower()) for w in found], [short_hash(shape(w)) for w in found])):
        for i, v in enumerate(values):
            if i == 0:
                pair = 1
            elif kind == 0 and values[i - 1] == v:
                pair = 0x51ED270B
            else:
                pair = spread(values[i - 1], 31) ^ v
            for j, gram in enumerate((v, pair)):
                grams[spread(gram, 41 + 2 * kind + j) % (BUCKETS - 1) + 1] += 1
    return {0: 1.0} | {g: SCALE * n / (4 * len(found)) for g, n in grams.items()}


def learned(examples):
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(g):
        if abs(z[g]) <= L1:
            return 0.0
        return -math.copysign(abs(z[g]) - L1, z[g]) / ((BETA + math.sqrt(n[g])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for x, label in examples:
            w = {g: weight(g) for g in x}
            gap = 1 / (1 + math.exp(-sum(w[g] * v for g, v in x.items()))) - label
            for g, v in x.items():
                step = gap * v
                z[g] += step - (math.sqrt(n[g] + step * step) - math.sqrt(n[g])) / ALPHA * w[g]
                n[g] += step * step
    return {g: weight(g) for g in z}


def test_quality_query_agrees_with_a_plain_version(spark, small):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{small}/labels.parquet").to_pylist()}
    taught = [d for d in labels if d in docs and zlib.crc32(str(d).encode()) % 4 != 2]
    turn = {r["d"]: r["t"] for r in spark.createDataFrame([(d,) for d in taught], "d long").select("d", F.xxhash64("d", F.lit(5)).alias("t")).collect()}
    x = {d: features(t) for d, t in docs.items()}
    weights = learned([(x[d], labels[d]) for d in sorted(taught, key=turn.get)])
    expected = {d: 1 / (1 + math.exp(-sum(weights.get(g, 0.0) * v for g, v in f.items()))) for d, f in x.items()}

    got = op5_quality(spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert abs(r["score"] - expected[r["doc_id"]]) < 1e-5
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.7)
    assert len({round(v, 6) for v in expected.values()}) > len(docs) // 2 and max(expected.values()) - min(expected.values()) > 0.2
