"""Nested documents for publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standings_arrays(table: DataFrame, group=("season", "grp")) -> DataFrame:
    """One row per group with its table as an ordered array of structs."""
    row = F.struct(*[F.col(c).alias(n) for c, n in (("position", "pos"), ("team", "team"), ("points", "pts"), ("played", "j"), ("won", "g"), ("drawn", "e"), ("lost", "p"), ("gf", "gf"), ("ga", "gc"), ("gd", "df"))])
    return table.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("standings"))


def history(fixtures: DataFrame, group=("season", "grp")) -> DataFrame:
    """One row per group with its rounds in order, each with its fixtures in order (a map would lose the order)."""
    match = F.struct("match_date", "match_id", "home", "away", F.col("home_score").alias("hs"), F.col("away_score").alias("as"))
    rounds = fixtures.groupBy(*group, "round").agg(F.array_sort(F.collect_list(match)).alias("matches"))
    return rounds.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("round", "matches"))).alias("rounds"))


def timelines(fixtures: DataFrame, goals: DataFrame) -> DataFrame:
    """match_id, key and the goals of every fixture that has any, by minute."""
    lists = goals.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("minute", F.lit(9999)).alias("m"), "event_id", "player", "score", "side"))).alias("g"))
    return fixtures.join(lists, "match_id")


def category_documents(table: DataFrame, fixtures: DataFrame, group=("season", "grp")) -> DataFrame:
    """One JSON document per group: its table and its history."""
    both = standings_arrays(table, group).join(history(fixtures, group), list(group))
    return both.select(*group, F.to_json(F.struct(*group, "standings", "rounds")).alias("document"))


def season_statistics(streaks: DataFrame, records: DataFrame, goals: DataFrame, curves: DataFrame, group=("season", "grp", "team")) -> DataFrame:
    """One JSON document per season with every team's statistics."""
    keys = list(group)
    team = streaks.join(records, keys).join(goals, keys).join(curves, keys)
    row = F.struct("grp", "team", F.struct("streak", "length").alias("streak"), F.struct("home_won", "home_drawn", "home_lost", "home_pct").alias("home"), F.struct("away_won", "away_drawn", "away_lost", "away_pct").alias("away"), "avg_gf", "avg_ga", "points_history")
    return team.groupBy("season").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("document"))


def write_seasons(documents: DataFrame, path: str) -> None:
    """A folder of JSON lines per season, so that a reader of one season reads nothing else."""
    documents.repartition("season").write.mode("overwrite").partitionBy("season").json(path)
