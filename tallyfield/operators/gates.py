"""Data-quality checks and guards against bad loads.  Each returns rows; nothing is collected here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1")


def self_matches(fixtures: DataFrame) -> DataFrame:
    return fixtures.where("home = away or trim(home) = '' or trim(away) = ''")


def outside(rows: DataFrame, column: str, allowed: tuple) -> DataFrame:
    """Rows whose value is not an allowed one."""
    return rows.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def arithmetic_share(table: DataFrame, group=("season", "grp"), slack: int = 6) -> DataFrame:
    """For each group: rows whose matches or points do not add up, and whether they are under five percent."""
    bad = (F.col("played") != F.col("won") + F.col("drawn") + F.col("lost")) | (F.abs(F.col("points") - F.col("won") * 3 - F.col("drawn")) > slack)
    return table.groupBy(*group).agg(F.count("*").alias("teams"), F.count_if(bad).alias("bad")).withColumn("passes", F.col("bad") * 20 < F.col("teams"))


def replacement_guard(stored: DataFrame, incoming: DataFrame, group: list[str]) -> DataFrame:
    """Why a group's incoming table (…, team, played) must not replace the stored one; null if it may.

    Empty; a season that seems to have started again (most matches played fell from five or more to two or
    fewer); most matches played fell; fewer than half of the stored teams are left.
    """
    m = lambda t, n: t.groupBy(*group).agg(F.max("played").alias(f"{n}_played"), F.countDistinct("team").alias(f"{n}_teams"))
    kept = stored.select(*group, "team").distinct().join(incoming.select(*group, "team").distinct(), [*group, "team"]).groupBy(*group).agg(F.count("*").alias("common"))
    both = m(stored, "stored").join(m(incoming, "incoming"), group, "left").join(kept, group, "left")
    overlap = F.coalesce("common", F.lit(0)) * 2
    reason = (
        F.when(F.col("incoming_teams").isNull(), "empty")
        .when((F.col("stored_played") >= 5) & (F.col("incoming_played") <= 2), "restarted")
        .when(F.col("incoming_played") < F.col("stored_played"), "fewer played")
        .when(overlap < F.col("stored_teams"), "other teams")
    )
    return both.select(*group, "stored_played", "incoming_played", reason.alias("reason"))


def rollover_abort(guarded: DataFrame, least: int = 3, share: float = 0.25) -> DataFrame:
    """Whether a whole load must stop: nothing was updated, or at least ``least`` and a ``share`` of groups were skipped."""
    agg = guarded.agg(F.count("*").alias("n_groups"), F.count("reason").alias("skipped"))
    stop = (F.col("skipped") == F.col("n_groups")) | ((F.col("skipped") >= least) & (F.col("skipped") >= share * F.col("n_groups")))
    return agg.withColumn("abort", stop)


def finished_fixtures(fixtures: DataFrame) -> DataFrame:
    """Fixtures of a season that is over: both teams named and different, both scores known.

    What has no score then is no fixture to come but a row that strayed in from elsewhere.
    """
    return fixtures.where("home <> '' and away <> '' and home <> away and home_score is not null and away_score is not null")


def match_counts(groups: DataFrame, history: DataFrame, listed: DataFrame, rounds: DataFrame, key: str = "grp") -> DataFrame:
    """The matches of each group by the first source that has any row of it: its history, its own list, its rounds.

    Each source has one row for a match; a group that no source knows has 0.
    """
    n = lambda t, c: t.groupBy(key).agg(F.count("*").alias(c))
    out = groups.select(key).distinct()
    for t, c in ((history, "in_history"), (listed, "in_list"), (rounds, "in_rounds")):
        out = out.join(n(t, c), key, "left")
    source = F.when(F.col("in_history").isNotNull(), "history").when(F.col("in_list").isNotNull(), "list").when(F.col("in_rounds").isNotNull(), "rounds")
    return out.select(key, source.alias("source"), F.coalesce("in_history", "in_list", "in_rounds", F.lit(0)).alias("matches"))


def fill_report(fixtures: DataFrame, group=("season",)) -> DataFrame:
    """Per group: fixtures, played, half and absurd scores, from raw_home and raw_away."""
    h, a = F.col("raw_home"), F.col("raw_away")
    absurd = F.coalesce(~h.between(0, 50), F.lit(False)) | F.coalesce(~a.between(0, 50), F.lit(False))
    return fixtures.groupBy(*group).agg(
        F.count("*").alias("fixtures"),
        F.count_if(h.isNotNull() & a.isNotNull()).alias("played"),
        F.count_if(h.isNull() != a.isNull()).alias("half"),
        F.count_if(absurd).alias("absurd"),
    )


def fill_verdict(report: DataFrame, baseline: DataFrame, group=("season",)) -> DataFrame:
    """Each group's report against a baseline of played counts: ok, fewer or suspect."""
    both = report.join(baseline.select(*group, F.col("played").alias("before")), list(group), "left")
    delta = F.col("played") - F.coalesce("before", F.lit(0))
    verdict = F.when(delta < 0, "fewer").when(F.col("absurd") * 10 > F.col("fixtures"), "suspect").otherwise("ok")
    return both.select(*group, "fixtures", "played", "absurd", delta.alias("delta"), verdict.alias("verdict"))


def only_in_one(table: DataFrame, calendar: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Teams in the table alone or in the calendar alone."""
    t, c = (x.select(*group, "team").distinct() for x in (table, calendar))
    return t.join(c, [*group, "team"], "left_anti").withColumn("only_in", F.lit("table")).unionByName(c.join(t, [*group, "team"], "left_anti").withColumn("only_in", F.lit("calendar")))


def block_sizes(blocks: DataFrame, expected: tuple[int, ...], group: tuple[str, ...]) -> DataFrame:
    """Whether the sizes of a group's blocks, in order, are as a tournament's plan says."""
    rows = blocks.withColumn("seq", F.row_number().over(Window.partitionBy(*group).orderBy("first")))
    sizes = rows.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "size"))), lambda x: x["size"].cast("int")).alias("sizes"))
    return sizes.withColumn("as_planned", F.col("sizes") == F.array(*[F.lit(x) for x in expected]))


def count_gap(stored: DataFrame, published: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Groups whose published rows are not as many as the stored ones."""
    n = lambda t, c: t.groupBy(*group).agg(F.count("*").alias(c))
    both = n(stored, "n_stored").join(n(published, "n_published"), list(group), "full")
    return both.where(~F.col("n_stored").eqNullSafe(F.col("n_published")))
