"""Players, line-ups and match events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_counts(events: DataFrame, group=("match_id", "player")) -> DataFrame:
    """Goals, yellow and red cards by (match, player); own goals count for the scorer and the team is no key."""
    return events.groupBy(*group).agg(*[F.count_if(F.col("kind") == k).alias(name) for k, name in (("goal", "goals"), ("yellow", "yellow"), ("red", "red"))])


def player_aggregates(appearances: DataFrame, group=("team", "player")) -> DataFrame:
    """Appearances, starts, goals and cards of each player."""
    return appearances.groupBy(*group).agg(
        F.count("*").alias("apps"),
        F.count_if(F.col("role") == "starter").alias("starts"),
        F.coalesce(F.sum("goals"), F.lit(0)).cast("long").alias("goals"),
        F.coalesce(F.sum("yellow"), F.lit(0)).cast("long").alias("yellow"),
        F.coalesce(F.sum("red"), F.lit(0)).cast("long").alias("red"),
    )


def player_log(appearances: DataFrame, own_team: DataFrame | None = None) -> DataFrame:
    """Each player's matches in order with running totals; with ``own_team`` (player, team) only for that team."""
    if own_team is not None:
        appearances = appearances.join(own_team, ["player", "team"], "left_semi")
    order = Window.partitionBy("player").orderBy("match_id", "team")
    return appearances.select("player", F.row_number().over(order).cast("int").alias("n"), "match_id", "team", "goals", F.sum("goals").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("goals_so_far"))


def running_score(events: DataFrame, group=("match_id",)) -> DataFrame:
    """The score after each goal in minute order; home goals come first within a minute, unknown minutes last."""
    order = Window.partitionBy(*group).orderBy(F.asc_nulls_last("minute"), F.col("side") != "h", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    goals = events.where("kind = 'goal'")
    count = lambda s: F.count_if(F.col("side") == s).over(order).cast("string")
    return goals.select(*group, "event_id", "minute", "side", F.concat_ws("-", count("h"), count("a")).alias("score"))


def timeline(events: DataFrame, group=("match_id",)) -> DataFrame:
    """Events numbered by minute, unknown minutes last, then by id."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(*group).orderBy(F.asc_nulls_last("minute"), "event_id")).cast("int"))


def substitution_pairs(events: DataFrame, group=("match_id", "team")) -> DataFrame:
    """Substitutions paired in order, the n-th off with the n-th on; each pair once, a lone one with null."""
    subs = events.where("kind in ('sub_in', 'sub_out')").withColumn("n", F.row_number().over(Window.partitionBy(*group, "kind").orderBy(F.asc_nulls_last("minute"), "event_id")).cast("int"))
    side = lambda kind, name: subs.where(F.col("kind") == kind).select(*group, "n", F.col("event_id").alias(f"{name}_event"), F.col("player").alias(f"{name}_player"))
    return side("sub_out", "off").join(side("sub_in", "on"), [*group, "n"], "full")


def lineup_order(lineup: DataFrame, group=("match_id", "team")) -> DataFrame:
    """Line-ups with ``seq``: roles in reverse order of name (sub before starter), then shirt number."""
    return lineup.withColumn("seq", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("role"), F.asc_nulls_first("dorsal"), "player")).cast("int"))


def squad_order(squad: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """Squads with ``seq`` by a column, then appearances, then name in Spanish order."""
    first = F.desc(by) if descending else F.asc(by)
    return squad.withColumn("seq", F.row_number().over(Window.partitionBy("team").orderBy(first, F.desc("apps"), F.collate(F.col("player").cast("string"), "es"))).cast("int"))


def top_scorers(scorers: DataFrame, k: int, group: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` rows with most goals (of each group): fewer games, then team and player break ties."""
    order = [F.desc("goals"), F.asc("games"), F.asc("team"), F.asc("player")]
    if not group:
        return scorers.orderBy(*order).limit(k)
    return scorers.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("int")).where(F.col("rank") <= k)


def matches_with_events(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Matches that have at least one goal (a semi join, not a join made distinct)."""
    return matches.join(events.where("kind = 'goal'").select("match_id"), "match_id", "left_semi")
