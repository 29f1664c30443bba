"""Merging loads into what is stored.  Plain files have no MERGE, so each is a join or window over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_dimension(stored: DataFrame, incoming: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """Stored and new rows by natural key; an attribute changes only where the new value is not null."""
    new = incoming.groupBy(*key).agg(*[F.max(c).alias(f"new_{c}") for c in attributes])
    both = stored.join(new, key, "full")
    return both.select(*key, *[F.coalesce(f"new_{c}", c).alias(c) for c in attributes])


def one_of_each(rows: DataFrame, key: list[str], filled: list[str]) -> DataFrame:
    """One row of each key: one with all of ``filled`` if there is any, then the smallest values, nulls last."""
    missing = F.array_size(F.filter(F.array(*[F.col(c).isNull() for c in filled]), lambda x: x))
    order = Window.partitionBy(*key).orderBy(missing, *[F.asc_nulls_last(c) for c in rows.columns if c not in key])
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def fill_nulls(stored: DataFrame, incoming: DataFrame, key: list[str], filled: list[str]) -> DataFrame:
    """First row of a key wins; columns ``filled`` are taken from a later row only where they are all null."""
    once = one_of_each(incoming, key, filled)
    rest = [c for c in stored.columns if c not in key]
    old, new = stored.select(*key, F.struct(*rest).alias("old")), once.select(*key, F.struct(*rest).alias("new"))
    both = old.join(new, key, "full")
    missing = F.lit(True)
    for c in filled:
        missing = missing & F.col(f"old.{c}").isNull()
    pick = lambda c: F.when(F.col("old").isNull() | (missing if c in filled else F.lit(False)), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    return both.select(*[F.col(k) if k in key else pick(k) for k in stored.columns])


def last_wins(rows: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The row of each key that was loaded last; equal sequence numbers fall back on the other columns."""
    order = Window.partitionBy(*key).orderBy(F.desc(sequence), *[F.desc_nulls_last(c) for c in rows.columns if c not in (*key, sequence)])
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def first_claim(rows: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the later ones for the report."""
    n = rows.withColumn("claim", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return n.where("claim = 1").drop("claim"), n.where("claim > 1")


def played_counts(rows: DataFrame, group: list[str], name: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.count("*").alias(f"{name}_rows"), F.count_if(F.col("home_score").isNotNull() & F.col("away_score").isNotNull()).alias(name))


def no_regression(stored: DataFrame, incoming: DataFrame, group: list[str]) -> DataFrame:
    """What to do with each group: replace it if the load has strictly more played fixtures or nothing is stored.

    An empty load never replaces; a group that is not loaded stays.
    """
    both = played_counts(stored, group, "stored").join(played_counts(incoming, group, "incoming"), group, "full")
    has = F.coalesce("incoming_rows", F.lit(0)) > 0
    better = has & (F.col("stored_rows").isNull() | (F.coalesce("incoming", F.lit(0)) > F.coalesce("stored", F.lit(0))))
    return both.select(*group, F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("incoming", F.lit(0)).alias("incoming"), F.when(better, "replace").otherwise("keep").alias("action"))


def replace_groups(stored: DataFrame, incoming: DataFrame, group: list[str]) -> DataFrame:
    """Stored rows with the groups that :func:`no_regression` lets through replaced by the load's."""
    swap = no_regression(stored, incoming, group).where("action = 'replace'").select(*group)
    return stored.join(swap, group, "left_anti").unionByName(incoming.join(swap, group, "left_semi"))


def refreshed(stored: DataFrame, parsed: DataFrame, group: list[str]) -> DataFrame:
    """Stored rows with every group of which the parse gave any row replaced by the parsed rows; the others stay."""
    got = parsed.select(*group).distinct()
    return stored.join(got, group, "left_anti").unionByName(parsed.select(*stored.columns))


def pending(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Ids that have no result yet."""
    return ids.join(done.select(key), key, "left_anti")


def without_orphans(children: DataFrame, parents: DataFrame, key: str, scope: DataFrame | None = None, scope_key: str | None = None) -> DataFrame:
    """Children with the reference cleared where the parent is gone; with a scope, only inside it."""
    known = parents.select(F.col(key).alias("k"), F.lit(True).alias("known")).distinct()
    rows = children.join(known, F.col(key) == F.col("k"), "left")
    gone = F.col(key).isNotNull() & F.col("known").isNull()
    if scope is not None:
        inside = scope.select(F.col(scope_key).alias("s"), F.lit(True).alias("inside")).distinct()
        rows = rows.join(inside, F.col(scope_key) == F.col("s"), "left")
        gone = gone & F.col("inside").isNotNull()
    return rows.withColumn(key, F.when(~gone, F.col(key))).select(*children.columns)


def repointed(rows: DataFrame, aliases: DataFrame, columns: list[str], key: list[str], order: list[str]) -> DataFrame:
    """Rows with ids replaced by those they are aliases of; of rows that then collide the first stays."""
    for c in columns:
        a = aliases.select(F.col("id").alias(c), F.col("canonical_id").alias(f"__{c}"))
        rows = rows.join(a, c, "left").withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return first_claim(rows, key, order)[0]


def collisions(codes: DataFrame, code: str, existing: DataFrame | None = None) -> DataFrame:
    """Codes that a load has more than once or that are already taken; must be empty before anything is written."""
    twice = codes.groupBy(code).agg(F.count("*").alias("times")).where("times > 1").select(code)
    return twice if existing is None else twice.union(codes.join(existing, code, "left_semi").select(code)).distinct()


def by_strategy(candidates: DataFrame, key: str, rank: str = "strategy_rank") -> DataFrame:
    """Distinct ids from the best strategy that gave any for each key."""
    best = candidates.groupBy(key).agg(F.min(rank).alias(rank))
    return candidates.join(best, [key, rank]).distinct()


def digest(rows: DataFrame, columns: list[str]) -> Column | DataFrame:
    """rows and a 64-bit digest of a table that does not depend on the order of its rows."""
    return rows.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*columns)).alias("digest"))


def next_version(before: DataFrame, after: DataFrame, version: str, columns: list[str]) -> DataFrame:
    """The version a publication gets: the old one unless the table's digest changed.

    Versions are a day with optional letters; a second change on one day counts b, c, ... z, zb, zc, ...
    """
    day, letters = (F.regexp_extract(F.lit(version), r"^(\d{8})([b-z]*)$", i) for i in (1, 2))
    today = F.date_format(F.current_date(), "yyyyMMdd")
    last = F.right(letters, F.lit(1))
    following = F.when((letters == "") | (last == "z"), F.concat(letters, F.lit("b"))).otherwise(F.concat(F.substring(letters, F.lit(1), F.length(letters) - 1), F.chr(F.ascii(last) + 1)))
    again = F.concat(today, following)
    both = digest(before, columns).crossJoin(digest(after, columns).toDF("m_rows", "other"))  # two single rows
    same = (F.col("n_rows") == F.col("m_rows")) & F.col("digest").eqNullSafe(F.col("other"))
    return both.select(F.when(same, F.lit(version)).when(day == today, again).otherwise(today).alias("version"))
