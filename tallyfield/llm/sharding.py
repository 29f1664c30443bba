"""Sharding by sampled splitters.

The key of a record is (hash of its text, hash of its id): equal texts lie side by side.  A sample in which
a record's chance grows with its size gives quantile boundaries of the key.  One exact count over the ranges
between them finds the overfull ones; a text whose copies overfill a range gets a range of its own, which is
subdivided by the second part of the key, so that no task orders more than a range's share.  The ranges then go
to shards, the largest first to the emptiest shard.  The parts of one text stay in one shard unless they are
more than a shard's share.  Only a row per range and part reaches the driver, and their number is a parameter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import materialize

#: Keys drawn for the splitters, about; the sample that the driver sees has this size whatever the input.
SAMPLE_KEYS = 20_000
#: Ranges for each shard; a shard's bytes are off by about one part in this at most.
RANGES_PER_SHARD = 256
#: A range, or the copies of one text, of this many fair shares of a range is overfull.
OVERFULL = 3


def _hash(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def splitters(keyed: DataFrame, total: int, ranges: int, sample: int = SAMPLE_KEYS) -> list[int]:
    """Quantile boundaries of ``key`` by ``size``, from a sample that any layout of the rows draws alike."""
    chance = F.col("size") * F.lit(sample / max(total, 1))
    dice = F.pmod(_hash("key", "tie", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keyed.where(dice < chance).select("key", F.greatest(chance, F.lit(1.0)).alias("weight")).groupBy("key").agg(F.sum("weight").alias("weight"))
    rows = sorted((r["key"], r["weight"]) for r in drawn.collect())
    whole, seen, cuts = sum(w for _, w in rows), 0.0, []
    for key, weight in rows:
        seen += weight
        if seen >= whole * (len(cuts) + 1) / ranges and (not cuts or key > cuts[-1]):
            cuts.append(key)
            while len(cuts) < ranges and seen >= whole * (len(cuts) + 1) / ranges:
                cuts.append(key)
    return sorted(set(cuts))


def range_of(cuts: list[int], own: list[int]):
    """A function of a key column: the number of boundaries below the key; keys of ``own`` come after all ranges."""
    table, alone = np.array(cuts, np.int64), np.array(sorted(own), np.int64)

    @F.pandas_udf("int")
    def below(key: pd.Series) -> pd.Series:
        keys = key.to_numpy()
        found = np.searchsorted(table, keys, side="left")
        if len(alone):
            at = np.minimum(np.searchsorted(alone, keys), len(alone) - 1)
            found = np.where(alone[at] == keys, len(table) + 1 + at, found)
        return pd.Series(found.astype(np.int32))

    return below


def part_of(parts: dict[int, int], ranges: int):
    """A function of range and ``tie``: which part of a subdivided range a row goes to, by equal widths of the hash."""
    table = np.ones(ranges, np.int64)
    for k, n in parts.items():
        table[k] = n

    @F.pandas_udf("int")
    def part(range_: pd.Series, tie: pd.Series) -> pd.Series:
        share = ((tie.to_numpy(np.int64) >> 20) + (1 << 43)).astype(np.float64) / float(1 << 44)
        return pd.Series((share * table[range_.to_numpy()]).astype(np.int32))

    return part


def _assigned(keyed: DataFrame, shards: int, ranges_per_shard: int) -> DataFrame:
    """Ranges, parts of overfull ranges, shards and slots for rows with size, key and tie."""
    spark = keyed.sparkSession
    keyed = materialize(keyed, "shard-keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(keyed, total, shards * ranges_per_shard)
    fair, share = max(total / (shards * ranges_per_shard), 1), max(total / shards, 1)
    ranged = keyed.withColumn("range", range_of(cuts, [])("key"))
    full = ranged.groupBy("range").agg(F.sum("size").alias("n")).where(F.col("n") >= OVERFULL * fair).select("range")
    within = ranged.join(F.broadcast(full), "range", "left_semi")  # at most a row for each range
    own = {r["key"]: r["n"] for r in within.groupBy("key").agg(F.sum("size").alias("n")).where(F.col("n") >= OVERFULL * fair).collect()}
    first = len(cuts) + 1
    parts = {first + i: -(-own[k] // int(fair)) for i, k in enumerate(sorted(own))}
    placed = keyed.withColumn("range", range_of(cuts, list(own))("key")).withColumn("part", part_of(parts, first + len(own))("range", "tie"))
    counts = sorted(tuple(r) for r in placed.groupBy("range", "part").agg(F.sum("size"), F.count("*")).collect())
    units: dict[tuple, list] = {}  # what stays together: a range, or a part of a text that no shard holds
    for k, part, size, n in counts:
        alone = k >= first and own[sorted(own)[k - first]] > share
        units.setdefault((k, part if alone else -1), []).append((k, part, size, n))
    emptiest, rows, table = [(0, shard) for shard in range(shards)], [0] * shards, []
    for _, unit in sorted(units.items(), key=lambda u: (-sum(c[2] for c in u[1]), u[0])):
        held, shard = heapq.heappop(emptiest)
        for k, part, size, n in unit:
            table.append((k, part, shard, rows[shard]))
            held, rows[shard] = held + size, rows[shard] + n
        heapq.heappush(emptiest, (held, shard))
    where = spark.createDataFrame(table, "range int, part int, shard int, before long")
    order = Window.partitionBy("range", "part").orderBy("key", "tie", "doc_id")
    return placed.withColumn("row", F.row_number().over(order)).join(F.broadcast(where), ["range", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("row") - 1).alias("slot"))


def shard_by_bytes(docs: DataFrame, shards: int = 8, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of (doc_id, text).

    ``size`` is the UTF-8 bytes of the text plus one (null text: one).  Shards get nearly equal bytes; equal
    texts share a shard unless their copies are more than a shard's share.  ``slot`` runs from 0 without gaps
    in each shard.  Null ids are keys like any other, repeated rows are separate records, an empty table
    gives no rows, other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        _hash(text).alias("key"),
    ).withColumn("tie", _hash("doc_id", "key"))
    return _assigned(keyed, shards, ranges_per_shard)
