"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source may be taken ``target / source_size`` times: a whole number of copies and a
fraction.  Pairs of documents pass each other *words* (fraction times size) until one of the two has a whole
number of copies; which way the mass goes is drawn so that every fraction keeps its expectation.  The words
a source gives therefore never move, except for one last document.  Groups of documents are paired in
parallel, each leaves at most one fractional document, and these meet in groups of ``FAN_IN``, level after
level, until a source has one left, which is rounded by its own fraction.  A long document that a group would
leave over is settled as well, against short ones that pass on or take up its words, so that what is left over
is short and targets are met closely.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import materialize, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Documents paired by one task's group, about, and groups that meet at each level of the tree; a source with fewer
#: documents is one group, in which all of them can settle what is left over.
GROUP_ROWS = 20_000
FAN_IN = 32
#: A group draws its left-over document again until it has at most this share of the words taken, so many times at most.
CLOSE, SETTLE_STEPS = 0.003, 400


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target: a row per source (null is one), from (source, size).

    Sources in order of code point, null last, have ``weights`` in turn.  Targets are proportional to them
    and stop at ``most`` times the source's size.  Ordered by size over weight, the sources that stop are
    the first ones; a running sum finds the level that the others share.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"), "source"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("weight", F.element_at(table, ((rank - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("most", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns(
        {
            "left": F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(order), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)),
        }
    )
    by = by.withColumn("stops", F.col("most") * F.col("open") <= F.col("left") * F.col("weight"))
    level = F.max(F.when(~F.col("stops"), F.struct("open", F.col("left").alias("l")))).over(everything)
    return by.select("source", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(level["l"] * F.col("weight") / level["open"]).alias("target"))


def _dice(keys: np.ndarray, seed: int) -> np.ndarray:
    rest = (keys.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((rest ^ (rest >> np.uint64(29))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(fraction: np.ndarray, size: np.ndarray, dice: np.ndarray) -> tuple[np.ndarray, int]:
    """Round all fractions but one: the new fractions and the place of the one left over, or -1."""
    out, held = fraction.tolist(), -1
    for j, (q, b) in enumerate(zip(fraction.tolist(), size.tolist(), strict=True)):
        if not 0 < q < 1:
            continue
        if held < 0:
            held = j
            continue
        p, a = out[held], size[held]
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))  # words that can go to the held one, and away
        if dice[j] * (up + down) < down:
            full, empty = a * (1 - p) <= b * q, b * q <= a * (1 - p)
            p, q = (1.0 if full else p + up / a), (0.0 if empty else q - up / b)
        else:
            empty, full = a * p <= b * (1 - q), b * (1 - q) <= a * p
            p, q = (0.0 if empty else p - down / a), (1.0 if full else q + down / b)
        out[held], out[j] = p, q
        held = held if 0 < p < 1 else j if 0 < q < 1 else -1
    return np.array(out), held


def settle(fraction: np.ndarray, size: np.ndarray, held: int, dice: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the document left over and pass the words it gains or gives to settled ones: the new one left over.

    It goes up with the probability of its fraction.  Going up it takes its words from documents at one, going
    down it gives them to documents at zero, in an order that is drawn; the shortest of those is left over.
    """
    out, up = fraction.copy(), dice[held] * 1e6 % 1 < fraction[held]
    words = size[held] * (1 - out[held] if up else out[held])
    other = np.flatnonzero((out == (1 if up else 0)) & (np.arange(len(out)) != held) & (size > 0))
    if not len(other) or size[other].min() >= size[held]:
        return out, held
    flipped = []
    for j in other[np.argsort(dice[other], kind="stable")].tolist():
        if size[j] <= words:
            words -= size[j]
            flipped.append(j)
    out[flipped] = 0 if up else 1
    out[held] = 1 if up else 0
    rest = np.setdiff1d(other, flipped)
    if words <= 1e-9 * size[held]:
        return out, -1
    last = rest[np.argmin(size[rest])] if len(rest) else held  # all of the rest are longer than what is left
    share = words / size[last]
    out[last] = 1 - share if up else share
    return out, int(last)


def settled(fraction: np.ndarray, size: np.ndarray, held: int, keys: np.ndarray, level: int) -> tuple[np.ndarray, int]:
    """Settle until the document left over is short beside the words taken, or has been drawn often enough.

    Every step keeps expectations, so stopping by what is left over keeps them as well.
    """
    close = CLOSE * float((fraction * size).sum())
    for step in range(SETTLE_STEPS):
        if held < 0 or size[held] <= close and step:
            break
        fraction, held = settle(fraction, size, held, _dice(keys, level * 2 + 1 + step * 1009))
    return fraction, held


def _round_groups(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """Pair the documents of each (source, group); ``open`` marks what is left for the next level."""

    def paired(frame: pd.DataFrame) -> pd.DataFrame:
        # the longest first: what is left over at the end, and misses the target by its size, is short
        frame = frame.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
        dice = _dice(frame["key"].to_numpy(), level * 2 + 1)
        fraction, held = pivot(frame["fraction"].to_numpy(np.float64), frame["size"].to_numpy(np.float64), dice)
        fraction, held = settled(fraction, frame["size"].to_numpy(np.float64), held, frame["key"].to_numpy(), level)
        if held >= 0 and last:
            fraction[held] = float(_dice(frame["key"].to_numpy()[held : held + 1], 0)[0] < fraction[held])
            held = -1
        frame["fraction"], frame["open"] = fraction, np.arange(len(frame)) == held
        return frame

    return rows.groupBy("source", "group").applyInPandas(paired, rows.schema)


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of (doc_id, text, source).

    ``size`` counts words (null text: 0).  ``taken`` is ``size`` times ``copies``, which is 0 .. ``most``.
    A document without words is taken 0 times.  Null sources form one source; null ids are allowed; repeated
    rows are separate documents.  Draws come from a hash of id and size, and groups from the same hash, so
    reruns and other layouts of the rows agree.  An empty table gives no rows.
    """
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, most), "mix-targets")
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"]), "left").drop(targets["source"])
    wanted = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    n = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    levels = max(0, math.ceil(math.log(max(n / GROUP_ROWS, 1), FAN_IN)))
    key = F.xxhash64("doc_id", "size")
    rows = rows.withColumns({"wanted": wanted, "key": key, "group": F.pmod(key, F.lit(FAN_IN**levels)), "open": F.lit(True)})
    rows = rows.withColumns({"whole": F.floor("wanted"), "fraction": F.col("wanted") - F.floor("wanted")}).drop("wanted")
    settled = rows.where("fraction = 0 or fraction >= 1").withColumn("open", F.lit(False))
    left = rows.where("fraction > 0 and fraction < 1")
    parts = [settled]
    for level in range(levels + 1):
        done = materialize(_round_groups(left, level, last=level == levels), f"mix-level{level}")
        parts.append(done.where("not open"))
        left = done.where("open").withColumn("group", F.floor(F.col("group") / FAN_IN))
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    copies = (F.col("whole") + F.round("fraction")).cast("int")
    return everything.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows that agree in doc_id, source and size share the copies drawn for them as evenly as they divide.
    """
    drawn = mix_sources(docs, weights, share, most).groupBy("doc_id", "source", "size").agg(F.count("*").alias("__rows"), F.sum("copies").alias("__all")).where("__all > 0")
    drawn = materialize(drawn, "mix-copies").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "__rows", "__all")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (word_count(F.col("text")) == F.col("__size"))
    rows = docs.join(drawn.hint("shuffle_hash"), same)
    one = rows.where("__rows = 1").withColumn("__copies", F.col("__all"))
    turn = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64("text")))
    several = rows.where("__rows > 1").withColumn("__copies", F.floor(F.col("__all") / F.col("__rows")) + (turn <= F.col("__all") % F.col("__rows")).cast("long"))
    every = one.unionByName(several).where("__copies > 0")
    return every.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")
