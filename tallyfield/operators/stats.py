"""Statistics over fixtures: streaks, form, records, season totals, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.standings import sides
from tallyfield.schema import FIXTURE_ORDER

TEAM = ("season", "grp", "team")


def _chronological(group=TEAM, newest_first: bool = False) -> Window:
    return Window.partitionBy(*group).orderBy(*[(F.desc if newest_first else F.asc)(c) for c in FIXTURE_ORDER])


def results(fixtures: DataFrame) -> DataFrame:
    """Played fixtures from each side."""
    return sides(fixtures).where("result is not null")


def current_streak(fixtures: DataFrame, group=TEAM) -> DataFrame:
    """result and length of each team's trailing run of equal results."""
    back = results(fixtures).withColumn("n", F.row_number().over(_chronological(group, newest_first=True)))
    last = F.max_by("result", -F.col("n")).over(Window.partitionBy(*group))
    back = back.withColumn("last", last)
    broken = F.min(F.when(F.col("result") != F.col("last"), F.col("n")))
    return back.groupBy(*group).agg(F.first("last").alias("streak"), (F.coalesce(broken, F.max("n") + 1) - 1).cast("int").alias("length"))


def points_history(fixtures: DataFrame, group=TEAM) -> DataFrame:
    """seq and cumulative points after each played fixture."""
    order = _chronological(group)
    rows = results(fixtures)
    return rows.select(*group, F.row_number().over(order).cast("int").alias("seq"), F.sum("pts").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("total"))


def points_curve(fixtures: DataFrame, group=TEAM) -> DataFrame:
    """The history as one array per team."""
    pairs = F.array_sort(F.collect_list(F.struct("seq", "total")))
    return points_history(fixtures, group).groupBy(*group).agg(F.transform(pairs, lambda x: x["total"]).alias("points_history"))


def recent_form(fixtures: DataFrame, last: int = 5, group=TEAM, by_round: bool = True) -> DataFrame:
    """The last results, oldest first, as one string; by round number and day, or by day alone."""
    columns = (["round"] if by_round else []) + list(FIXTURE_ORDER)
    back = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in columns])
    rows = results(fixtures).withColumn("n", F.row_number().over(back)).where(F.col("n") <= last)
    return rows.groupBy(*group).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "result"))), lambda x: x["result"])).alias("form"))


def home_away_record(fixtures: DataFrame, group=TEAM) -> DataFrame:
    """Won, drawn, lost and the share won in whole percent, at home and away."""
    rows = results(fixtures)
    out = rows.groupBy(*group).agg(
        *[F.count_if((F.col("at_home") == at_home) & (F.col("result") == r)).cast("int").alias(f"{name}_{word}") for at_home, name in ((True, "home"), (False, "away")) for r, word in (("W", "won"), ("D", "drawn"), ("L", "lost"))]
    )
    for name in ("home", "away"):
        games = F.col(f"{name}_won") + F.col(f"{name}_drawn") + F.col(f"{name}_lost")
        out = out.withColumn(f"{name}_pct", F.when(games > 0, F.floor((F.col(f"{name}_won") * 200 + games) / (games * 2))).cast("int"))
    return out


def average_goals(fixtures: DataFrame, group=TEAM) -> DataFrame:
    """Mean goals for and against, to one place (tenths, half up, in whole numbers)."""
    tenth = lambda c: (F.floor((F.sum(c) * 20 + F.count("*")) / (F.count("*") * 2)) / 10).alias(f"avg_{c}")
    return results(fixtures).groupBy(*group).agg(tenth("gf"), tenth("ga"))


def extreme_results(fixtures: DataFrame, best: bool, group=TEAM) -> DataFrame:
    """Each team's best or worst result by goal difference; the first in time wins ties."""
    rows = results(fixtures).withColumns({"diff": F.col("gf") - F.col("ga"), "seq": F.row_number().over(_chronological(group))})
    key = F.struct(F.col("diff") if best else -F.col("diff"), -F.col("seq"))
    found = rows.groupBy(*group).agg(F.max_by(F.struct("diff", "gf", "ga", "opponent", "match_date"), key).alias("x"))
    return found.select(*group, "x.*")


def season_totals(fixtures: DataFrame, cups: DataFrame) -> DataFrame:
    """matches, goals and goals a match (two places) of each season's league groups, or of all if it has none."""
    played = fixtures.where("home_score is not null and away_score is not null").join(cups.select("season", "grp", F.lit(True).alias("cup")).distinct(), ["season", "grp"], "left")
    goals = F.col("home_score") + F.col("away_score")
    league = F.col("cup").isNull()
    sums = played.groupBy("season").agg(F.count_if(league).alias("lm"), F.sum(F.when(league, goals)).alias("lg"), F.count("*").alias("m"), F.sum(goals).alias("g"))
    matches, total = F.when(F.col("lm") > 0, F.col("lm")).otherwise(F.col("m")), F.when(F.col("lm") > 0, F.col("lg")).otherwise(F.col("g"))
    return sums.select("season", matches.alias("matches"), total.alias("goals"), (F.floor((total * 200 + matches) / (matches * 2)) / 100).alias("average"))


def season_extremes(standings: DataFrame, least_games: int = 10) -> DataFrame:
    """Each season's team with most goals and team with fewest against, of those with enough games.

    The first by group and position wins ties.
    """
    rows = standings.where(F.col("played") >= least_games)
    most = F.min_by(F.struct("team", "gf"), F.struct(-F.col("gf"), F.col("grp"), F.col("position"))).alias("most")
    fewest = F.min_by(F.struct("team", "ga"), F.struct(F.col("ga"), F.col("grp"), F.col("position"))).alias("fewest")
    out = rows.groupBy("season").agg(most, fewest)
    return out.select("season", F.col("most.team").alias("most_goals_team"), F.col("most.gf").alias("most_goals"), F.col("fewest.team").alias("least_conceded_team"), F.col("fewest.ga").alias("least_conceded"))


def historical_team_goals(standings: DataFrame) -> DataFrame:
    """Goals for and against of each team over all groups of a season, cups too; zeros are left out."""
    return standings.groupBy("season", "team").agg(F.sum("gf").cast("long").alias("gf"), F.sum("ga").cast("long").alias("ga")).where("gf > 0 and ga > 0")


def top_matches(fixtures: DataFrame, by: str, k: int = 1, group=("season",)) -> DataFrame:
    """The ``k`` played fixtures of each group with the largest ``margin`` or ``total``; the other breaks ties, then order."""
    rows = fixtures.where("home_score is not null and away_score is not null").withColumns({"margin": F.abs(F.col("home_score") - F.col("away_score")), "total": F.col("home_score") + F.col("away_score")})
    second = "total" if by == "margin" else "margin"
    order = Window.partitionBy(*group).orderBy(F.desc(by), F.desc(second), *FIXTURE_ORDER)
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def top_by(rows: DataFrame, k: int, *order: Column, group=("season",)) -> DataFrame:
    """The first ``k`` rows of each group in the given order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("int")).where(F.col("rank") <= k)


def head_to_head(fixtures: DataFrame) -> DataFrame:
    """Meetings of each unordered pair of teams: wins of either, draws and goals."""
    a, b = F.least("home", "away"), F.greatest("home", "away")
    ga = F.when(F.col("home") < F.col("away"), F.col("home_score")).otherwise(F.col("away_score"))
    gb = F.when(F.col("home") < F.col("away"), F.col("away_score")).otherwise(F.col("home_score"))
    rows = fixtures.where("home_score is not null and away_score is not null").select(a.alias("team_a"), b.alias("team_b"), ga.alias("x"), gb.alias("y"))
    return rows.groupBy("team_a", "team_b").agg(
        F.count("*").alias("meetings"),
        F.count_if(F.col("x") > F.col("y")).alias("wins_a"),
        F.count_if(F.col("x") == F.col("y")).alias("draws"),
        F.count_if(F.col("x") < F.col("y")).alias("wins_b"),
        F.sum("x").cast("long").alias("goals_a"),
        F.sum("y").cast("long").alias("goals_b"),
    )


def compare_teams(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (season, grp, team_a, team_b): which has the better figures (a, b or = for each)."""
    side = lambda x: table.select("season", "grp", F.col("team").alias(f"team_{x}"), F.struct("points", "won", "gf", "ga").alias(x))
    both = pairs.join(side("a"), ["season", "grp", "team_a"]).join(side("b"), ["season", "grp", "team_b"])
    better = lambda c, less=False: F.when(F.col(f"a.{c}") == F.col(f"b.{c}"), "=").when((F.col(f"a.{c}") < F.col(f"b.{c}")) == less, "a").otherwise("b").alias(f"better_{c}")
    return both.select("season", "grp", "team_a", "team_b", better("points"), better("won"), better("gf"), better("ga", True))


def rank_window(table: DataFrame, teams: DataFrame, reach: int = 3, group=("season", "grp")) -> DataFrame:
    """Rows of a table within ``reach`` places of each given (group, team), and the leader's."""
    near = teams.join(table.select(*group, "team", F.col("position").alias("at")), [*group, "team"]).withColumnRenamed("team", "focus")
    places = near.withColumn("position", F.explode(F.array_union(F.array(F.lit(1)), F.sequence(F.greatest(F.col("at") - reach, F.lit(1)), F.col("at") + reach))))
    return places.join(table, [*group, "position"]).select(*group, "focus", "position", "team", "points")


def round_states(fixtures: DataFrame) -> DataFrame:
    """Fixtures and results of each round."""
    return fixtures.groupBy("season", "grp", "round").agg(F.count("*").alias("fixtures"), F.count(F.expr("home_score + away_score")).alias("results"))


def current_round(fixtures: DataFrame) -> DataFrame:
    """The last round with any result; the first round if none has one."""
    rounds = round_states(fixtures)
    return rounds.groupBy("season", "grp").agg(F.coalesce(F.max(F.when(F.col("results") > 0, F.col("round"))), F.min("round")).alias("round"))


def season_outlook(fixtures: DataFrame, today: Column) -> DataFrame:
    """The next fixture that is neither played nor past, else the last that was played, else none."""
    open_ = F.expr("home_score is null or away_score is null")
    key = F.struct(*FIXTURE_ORDER)
    coming = F.min(F.when(open_ & (F.col("match_date") >= today), key))
    done = F.max(F.when(~open_, key))
    out = fixtures.groupBy("season", "grp").agg(coming.alias("coming"), done.alias("done"))
    state = F.when(F.col("coming").isNotNull(), "upcoming").when(F.col("done").isNotNull(), "finished").otherwise("empty")
    return out.select("season", "grp", state.alias("state"), F.coalesce("coming.match_date", "done.match_date").alias("match_date"))


def finished_groups(fixtures: DataFrame, today: Column) -> DataFrame:
    """Whether every fixture of a group is played or past."""
    return fixtures.groupBy("season", "grp").agg(F.every(F.expr("home_score is not null and away_score is not null") | (F.col("match_date") < today)).alias("finished"))


def sparkline(history: DataFrame, width: int = 100, height: int = 20, group=TEAM) -> DataFrame:
    """Points of a line chart scaled into width x height, y downwards, from (seq, total)."""
    w = Window.partitionBy(*group)
    lo, hi = F.min("total").over(w), F.max("total").over(w)
    last = F.max("seq").over(w)
    x = F.when(last > 1, (F.col("seq") - 1) * width / (last - 1)).otherwise(F.lit(0.0))
    y = F.when(hi > lo, height - (F.col("total") - lo) * height / (hi - lo)).otherwise(F.lit(height / 2))
    return history.select(*group, "seq", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))
