"""Expressions over scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST_SCORE = 50


def sane(score: Column, largest: int = LARGEST_SCORE) -> Column:
    """The score if it is 0 .. largest, else null."""
    return F.when(score.between(0, largest), score)


def played(home: str = "home_score", away: str = "away_score", rule: str = "both") -> Column:
    """Whether a fixture was played: ``both`` scores are there, or only the home one is looked at (``home_only``)."""
    if rule == "home_only":
        return F.col(home).isNotNull()
    return F.col(home).isNotNull() & F.col(away).isNotNull()


def clean_scores(fixtures: DataFrame, home: str, away: str) -> DataFrame:
    """home_score and away_score from raw columns, which go: a score that is absurd or alone makes both null."""
    both = sane(F.col(home)).isNotNull() & sane(F.col(away)).isNotNull()
    return fixtures.withColumns({"home_score": F.when(both, F.col(home)), "away_score": F.when(both, F.col(away))}).drop(*{home, away} - {"home_score", "away_score"})


def rejected_scores(fixtures: DataFrame, home: str, away: str) -> DataFrame:
    """Counts of fixtures by what is wrong with their raw scores."""
    present = lambda c: F.col(c).isNotNull()
    absurd = (present(home) & sane(F.col(home)).isNull()) | (present(away) & sane(F.col(away)).isNull())
    return fixtures.agg(
        F.count("*").alias("fixtures"),
        F.count_if(~present(home) & ~present(away)).alias("unplayed"),
        F.count_if(present(home) != present(away)).alias("half"),
        F.count_if(absurd).alias("absurd"),
        F.count_if(sane(F.col(home)).isNotNull() & sane(F.col(away)).isNotNull()).alias("sane"),
    )


def oriented(home: Column, away: Column, winner: Column) -> tuple[Column, Column]:
    """Scores turned round where a winner's tag ('h' or 'a') contradicts them."""
    wrong = ((winner == "h") & (home < away)) | ((winner == "a") & (home > away))
    return F.when(wrong, away).otherwise(home), F.when(wrong, home).otherwise(away)


def result(gf: Column, ga: Column) -> Column:
    """W, D or L from one side's view; null if not played."""
    return F.when(gf > ga, "W").when(gf == ga, "D").when(gf < ga, "L")


def points(gf: Column, ga: Column) -> Column:
    return F.when(gf > ga, 3).when(gf == ga, 1).when(gf < ga, 0)


def match_key(home: Column, away: Column, home_score: Column, away_score: Column) -> Column:
    """``home|away|hs-as`` with the word null for a missing score; not unique over groups and seasons."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat(home, F.lit("|"), away, F.lit("|"), text(home_score), F.lit("-"), text(away_score))


def bar_width(value: Column, top: Column, least: int = 3) -> Column:
    """A bar's length in percent of ``top``, at least ``least`` and at most 100."""
    return F.greatest(F.lit(least), F.least(F.lit(100), F.floor(value * 100 / top + 0.5))).cast("int")
