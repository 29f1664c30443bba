"""League tables: computing, repairing and choosing between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.scores import points, result

GROUP = ("season", "grp")


def sides(fixtures: DataFrame) -> DataFrame:
    """Two rows per fixture, one from each team's view, with gf, ga, result and pts (null if not played)."""
    view = lambda team, other, at_home, gf, ga: F.struct(F.col(team).alias("team"), F.col(other).alias("opponent"), F.lit(at_home).alias("at_home"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    both = F.array(view("home", "away", True, "home_score", "away_score"), view("away", "home", False, "away_score", "home_score"))
    rows = fixtures.withColumn("side", F.explode(both)).select("*", "side.*").drop("side")
    return rows.withColumns({"result": result(F.col("gf"), F.col("ga")), "pts": points(F.col("gf"), F.col("ga"))})


def ranked(table: DataFrame, group=GROUP) -> DataFrame:
    """``position`` 1..n in each group: points, goal difference, goals for, then name."""
    order = Window.partitionBy(*group).orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "team")
    return table.withColumn("position", F.row_number().over(order).cast("int"))


def league_table(fixtures: DataFrame, include_unplayed: bool = True, group=GROUP) -> DataFrame:
    """The table of each group from its fixtures.

    A fixture without a result adds no points but, with ``include_unplayed``, still gives its teams a row.
    """
    rows = sides(fixtures)
    rows = rows if include_unplayed else rows.where("result is not null")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("int")
    times = lambda r: F.count_if(F.col("result") == r).cast("int")
    table = rows.groupBy(*group, "team").agg(
        total("pts").alias("points"),
        F.count("result").cast("int").alias("played"),
        times("W").alias("won"),
        times("D").alias("drawn"),
        times("L").alias("lost"),
        total("gf").alias("gf"),
        total("ga").alias("ga"),
        total(F.col("gf") - F.col("ga")).alias("gd"),
    )
    return ranked(table, group).select(*group, "position", "team", "points", "played", "won", "drawn", "lost", "gf", "ga", "gd")


def goals_for_against(fixtures: DataFrame, teams: DataFrame, group=GROUP) -> DataFrame:
    """Goals of played fixtures for the teams that ``teams`` (a column team) lists."""
    rows = sides(fixtures).where("result is not null").join(teams.select("team").distinct(), "team", "left_semi")
    return rows.groupBy(*group, "team").agg(F.sum("gf").cast("int").alias("gf"), F.sum("ga").cast("int").alias("ga"))


def with_goals(classification: DataFrame, goals: DataFrame, group=GROUP) -> DataFrame:
    """A published classification with goals counted from fixtures; none counted is zero."""
    return classification.drop("gf", "ga", "gd").join(goals, [*group, "team"], "left").withColumns(
        {"gf": F.coalesce("gf", F.lit(0)), "ga": F.coalesce("ga", F.lit(0))}
    ).withColumn("gd", F.col("gf") - F.col("ga"))


def repaired_points(table: DataFrame, slack: int = 6, group=GROUP) -> DataFrame:
    """Points that results rule out are counted again, and only then is the whole group ranked anew.

    A row is repaired if played = won + drawn + lost and its points differ from 3 won + drawn by more than
    ``slack`` (smaller gaps are sanctions).
    """
    right = F.col("won") * 3 + F.col("drawn")
    bad = (F.col("played") == F.col("won") + F.col("drawn") + F.col("lost")) & (F.abs(F.col("points") - right) > slack)
    table = table.withColumns({"points": F.when(bad, right).otherwise(F.col("points")).cast("int"), "repaired": bad})
    touched = F.max("repaired").over(Window.partitionBy(*group))
    return ranked(table.withColumnRenamed("position", "old"), group).withColumn("position", F.when(touched, F.col("position")).otherwise(F.col("old"))).drop("old")


def effective_standings(published: DataFrame, computed: DataFrame, cups: DataFrame | None = None, slack: int = 6, group=GROUP) -> DataFrame:
    """The published table of a group unless its fixtures show more matches; then the computed one.

    ``cups`` lists groups that keep what was published.  Points are repaired afterwards.
    """
    count = lambda t, name: t.groupBy(*group).agg(F.sum("played").alias(name))
    choice = count(published, "told").join(count(computed, "counted"), list(group), "full").select(*group, (F.coalesce("counted", F.lit(0)) > F.coalesce("told", F.lit(0))).alias("recount"))
    if cups is not None:
        choice = choice.join(cups.select(*group, F.lit(True).alias("cup")).distinct(), list(group), "left").withColumn("recount", F.col("recount") & F.col("cup").isNull()).drop("cup")
    told = published.join(choice.where("not recount"), list(group), "left_semi").withColumn("origin", F.lit("published"))
    counted = computed.join(choice.where("recount"), list(group), "left_semi").withColumn("origin", F.lit("computed"))
    return repaired_points(told.unionByName(counted), slack, group)


def divergence(published: DataFrame, computed: DataFrame, group=GROUP) -> DataFrame:
    """Teams whose published matches and points differ from those of their fixtures."""
    told = published.select(*group, "team", F.col("played").alias("told_played"), F.col("points").alias("told_points"))
    counted = computed.select(*group, "team", F.col("played").alias("counted_played"), F.col("points").alias("counted_points"))
    both = told.join(counted, [*group, "team"])
    return both.where("told_played <> counted_played or told_points <> counted_points")


def points_per_game(table: DataFrame, phases: DataFrame, most: int = 3) -> DataFrame:
    """One ranking over up to ``most`` groups of a competition: points a game to two places, points, difference."""
    ppg = F.when(F.col("played") > 0, F.round(F.col("points") / F.col("played"), 2)).otherwise(F.lit(0.0))
    order = Window.partitionBy("season").orderBy(F.desc("ppg"), F.desc("points"), F.desc("gd"), "team", "grp")
    rows = table.join(main_groups(phases, most), ["season", "grp"], "left_semi").withColumn("ppg", ppg)
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).select("season", "rank", "team", "grp", "ppg", "points", "gd")


def main_groups(phases: DataFrame, most: int = 3) -> DataFrame:
    """Groups of each season's largest phase (season, grp, phase, teams, first_seen): most teams, then first seen."""
    size = phases.groupBy("season", "phase").agg(F.sum("teams").alias("teams"), F.min("first_seen").alias("first_seen"))
    best = size.groupBy("season").agg(F.max_by("phase", F.struct("teams", -F.col("first_seen"), "phase")).alias("phase"))
    order = Window.partitionBy("season").orderBy("first_seen", "grp")
    return phases.join(best, ["season", "phase"], "left_semi").withColumn("i", F.row_number().over(order)).where(F.col("i") <= most).drop("i")


def split_totals(rows: DataFrame, columns=("played", "won", "drawn", "lost", "gf", "ga")) -> DataFrame:
    """Totals of tables that give home and away parts in columns home_x and away_x."""
    return rows.withColumns({c: (F.coalesce(f"home_{c}", F.lit(0)) + F.coalesce(f"away_{c}", F.lit(0))).cast("int") for c in columns}).drop(*[f"{s}_{c}" for c in columns for s in ("home", "away")])
