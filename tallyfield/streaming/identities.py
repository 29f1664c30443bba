"""Identities that outlast loads: which team a name means, decided once and kept as the state of a stream.

A club writes its name in many ways.  Names with one key are one team; the first name seen is the one that stays, and
the id given with it never changes, whatever later loads bring.  A badge changes when a load has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyfield.functions.text import team_key

STATE = "id long, name string, badge string"
FOUND = "identity string, name string, id long, canonical string, badge string"


def identity(name: Column) -> Column:
    """What equal teams share: the key of a name, or the name itself where nothing is left of it."""
    key = team_key(name)
    return F.when(key != "", F.concat(F.lit("k:"), key)).otherwise(F.concat(F.lit("n:"), name))


def _assigned(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The id and first name of a key for every name that a batch brings; state holds one row for a key.

    Of a batch the smallest (sequence, name) counts as the first and the largest with a badge as the last, so that
    the order of its rows does not matter; only those two and the distinct names are kept of it.
    """
    first = last = None
    names = {}
    for part in parts:
        for name, seq, badge, new_id in zip(part["name"], part["sequence"], part["badge"], part["new_id"], strict=True):
            names[name] = True
            if first is None or (seq, name) < first[:2]:
                first = (seq, name, new_id)
            if badge is not None and (last is None or (seq, name) >= last[:2]):
                last = (seq, name, badge)
    held = state.get if state.exists else (int(first[2]), first[1], None)
    held = (held[0], held[1], last[2] if last else held[2])
    state.update(held)
    yield pd.DataFrame({"identity": key[0], "name": sorted(names), "id": held[0], "canonical": held[1], "badge": held[2]})


def identified(names: DataFrame) -> DataFrame:
    """identity, name, id, canonical, badge for every name that a batch of (name, badge, sequence) brings.

    New ids come from a hash of the first name; they are kept in the state, so that they stay when a later load would
    have given another first name.  Rows without a name are left out.
    """
    rows = names.where(F.col("name").isNotNull()).select(identity(F.col("name")).alias("identity"), "name", "badge", F.col("sequence").cast("long").alias("sequence"), F.xxhash64("name").alias("new_id"))
    return rows.groupBy("identity").applyInPandasWithState(_assigned, FOUND, STATE, "update", GroupStateTimeout.NoTimeout)
