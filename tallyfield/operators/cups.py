"""Knock-out competitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators import standings
from tallyfield.operators.standings import sides

GROUP = ("season", "grp")


def cup_rounds(fixtures: DataFrame, group=GROUP) -> DataFrame:
    """Fixtures with ``round_seq``: rounds numbered by the first fixture in them."""
    first = fixtures.groupBy(*group, "round").agg(F.min(F.struct("match_date", "match_id")).alias("first"))
    numbered = first.withColumn("round_seq", F.row_number().over(Window.partitionBy(*group).orderBy("first", "round")).cast("int")).drop("first")
    return fixtures.join(numbered, [*group, "round"])


def champions(fixtures: DataFrame, group=GROUP) -> DataFrame:
    """The winner of the last played round, if that round has one played fixture and it was decided."""
    rows = cup_rounds(fixtures, group).where("home_score is not null and away_score is not null")
    last = rows.withColumn("last", F.max("round_seq").over(Window.partitionBy(*group))).where("round_seq = last")
    out = last.groupBy(*group).agg(F.count("*").alias("n"), F.first(F.when(F.col("home_score") > F.col("away_score"), F.col("home")).when(F.col("home_score") < F.col("away_score"), F.col("away"))).alias("champion"))
    return out.where("n = 1 and champion is not null").select(*group, "champion")


def cup_ranking(fixtures: DataFrame, group=GROUP) -> DataFrame:
    """Teams by deepest round, title, wins, points, goal difference, name."""
    rows = sides(cup_rounds(fixtures, group))
    sums = rows.groupBy(*group, "team").agg(
        F.max("round_seq").alias("deepest"),
        F.count_if(F.col("result") == "W").cast("int").alias("won"),
        F.coalesce(F.sum("pts"), F.lit(0)).cast("int").alias("points"),
        F.coalesce(F.sum(F.col("gf") - F.col("ga")), F.lit(0)).cast("int").alias("gd"),
    )
    sums = sums.join(champions(fixtures, group), list(group), "left").withColumn("is_champion", F.coalesce(F.col("team") == F.col("champion"), F.lit(False)))
    order = Window.partitionBy(*group).orderBy(F.desc("deepest"), F.desc("is_champion"), F.desc("won"), F.desc("points"), F.desc("gd"), "team")
    return sums.select(*group, F.row_number().over(order).cast("int").alias("position"), "team", "deepest", "is_champion", "won", "points", "gd")


def advancers(fixtures: DataFrame, group=GROUP) -> DataFrame:
    """Who went on from each decided or drawn tie of (…, round_seq, penalty_winner).

    The score decides; a draw goes by ``penalty_winner``, else to the one team seen in a later round.
    """
    seen = fixtures.select(*group, F.explode(F.array("home", "away")).alias("team"), "round_seq").groupBy(*group, "team").agg(F.max("round_seq").alias("deepest"))
    later = lambda side: seen.select(*group, F.col("team").alias(side), F.col("deepest").alias(f"{side}_deepest"))
    rows = fixtures.join(later("home"), [*group, "home"]).join(later("away"), [*group, "away"])
    home_on, away_on = F.col("home_deepest") > F.col("round_seq"), F.col("away_deepest") > F.col("round_seq")
    by_score = F.when(F.col("home_score") > F.col("away_score"), F.col("home")).when(F.col("home_score") < F.col("away_score"), F.col("away"))
    by_later = F.when(home_on & ~away_on, F.col("home")).when(away_on & ~home_on, F.col("away"))
    drawn = F.col("home_score") == F.col("away_score")
    return rows.withColumn("advancer", F.coalesce(by_score, F.when(drawn, F.coalesce(F.col("penalty_winner"), by_later)))).drop("home_deepest", "away_deepest")


def bracket_champions(ties: DataFrame, group=GROUP) -> DataFrame:
    """The advancer of a last round that is a single tie (from :func:`advancers`)."""
    last = ties.withColumn("last", F.max("round_seq").over(Window.partitionBy(*group))).where("round_seq = last")
    return last.groupBy(*group).agg(F.count("*").alias("ties"), F.first("advancer").alias("champion")).where("ties = 1 and champion is not null").select(*group, "champion")


def round_robin_cups(fixtures: DataFrame, group=GROUP) -> DataFrame:
    """Whether a competition is a round robin: its last round is no smaller than its first, or it has one round of over two."""
    sizes = cup_rounds(fixtures, group).groupBy(*group, "round_seq").count()
    agg = sizes.groupBy(*group).agg(F.min_by("count", "round_seq").alias("first"), F.max_by("count", "round_seq").alias("last"), F.count("*").alias("rounds"))
    return agg.select(*group, F.when(F.col("rounds") == 1, F.col("last") > 2).otherwise(F.col("last") >= F.col("first")).alias("round_robin"))


def consecutive_blocks(rows: DataFrame, number: str, group: tuple[str, ...]) -> DataFrame:
    """Runs of consecutive distinct numbers of each group: first, last and size."""
    order = Window.partitionBy(*group).orderBy(number)
    islands = rows.select(*group, number).distinct().withColumn("island", F.col(number) - F.row_number().over(order))
    return islands.groupBy(*group, "island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("size")).drop("island")


def tournament_faults(matches: DataFrame, letters: int, teams: int, cups: int, group: tuple[str, ...], seeds: int = 2) -> DataFrame:
    """Rules of a tournament's shape that its matches break: group, fault, place, found, expected.

    ``matches`` has number (one for each match of a tournament), home, away, home_score, away_score.  The first run of
    consecutive numbers is the group stage, its matches belong to ``letters`` groups in turn; every further run is a
    knock-out.  Broken is

    * ``stage``: the stage has not as many matches as ``letters`` round robins of ``teams``;
    * ``matches``, ``teams``, ``pairs``: the group ``place`` has not the matches, the teams, or the different pairs of
      teams of one round robin;
    * ``cups``: there are knock-outs, but not ``cups`` of them;
    * ``seeding``: the knock-out with the largest share of teams that came among the first ``seeds`` of their groups
      (of equal ones the first) is not the last one; found and expected are their places.

    A tournament without a knock-out breaks neither of the last two.  Tables are those of :mod:`standings`.
    """
    keys, every = list(group), Window.partitionBy(*group)
    robin = teams * (teams - 1) // 2
    runs = matches.withColumn("run", F.col("number") - F.dense_rank().over(every.orderBy("number")))
    runs = runs.withColumns({"block": F.dense_rank().over(every.orderBy("run")), "base": F.min("number").over(every)}).withColumn("letter", rotation_letter(F.col("number"), F.col("base"), letters))
    stage = runs.where("block = 1")
    fault = lambda name, place, found, expected: F.struct(F.lit(name).alias("fault"), place.cast("string").alias("place"), found.cast("int").alias("found"), F.lit(expected).cast("int").alias("expected"))
    nowhere = F.lit(None)
    sizes = runs.groupBy(*keys).agg(F.count_if(F.col("block") == 1).alias("stage"), (F.max("block") - 1).alias("cups"))
    whole = F.array(F.when(F.col("stage") != letters * robin, fault("stage", nowhere, F.col("stage"), letters * robin)), F.when(~F.col("cups").isin(0, cups), fault("cups", nowhere, F.col("cups"), cups)))
    names = F.flatten(F.collect_set(F.array("home", "away")))
    robins = stage.groupBy(*keys, "letter").agg(F.count("*").alias("n"), F.size(F.array_distinct(names)).alias("teams"), F.size(F.collect_set(F.array(F.least("home", "away"), F.greatest("home", "away")))).alias("pairs"))
    parts = F.array(*[F.when(F.col(c) != n, fault(name, F.col("letter"), F.col(c), n)) for name, c, n in (("matches", "n", robin), ("teams", "teams", teams), ("pairs", "pairs", robin))])

    first = standings.league_table(stage, include_unplayed=False, group=(*keys, "letter")).where(F.col("position") <= seeds).select(*keys, "team").distinct()
    playing = runs.where("block > 1").select(*keys, "block", F.explode(F.array("home", "away")).alias("team")).distinct()
    share = playing.join(first.withColumn("seed", F.lit(1)), [*keys, "team"], "left").groupBy(*keys, "block").agg((F.count("seed") / F.count("*")).alias("share"))
    best = share.groupBy(*keys).agg(F.max_by("block", F.struct("share", (-F.col("block")).alias("b"))).alias("best"), F.max("block").alias("last"))
    gold = best.where("best <> last").select(*keys, F.lit("seeding").alias("fault"), F.lit(None).cast("string").alias("place"), (F.col("best") - 1).cast("int").alias("found"), (F.col("last") - 1).cast("int").alias("expected"))

    broken = lambda rows, faults: rows.select(*keys, F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("f")).select(*keys, "f.*")
    return broken(sizes, whole).unionByName(broken(robins, parts)).unionByName(gold)


def split_rounds(rows: DataFrame, order: str, group: tuple[str, ...], most: int = 5) -> DataFrame:
    """Rounds of a bracket listed in order: from the end 1, 2, 4, .. ties; what is left over is preliminary.

    ``to_final`` is 0 for the final; the preliminary round, a block that is not full or lies before round
    ``most``, has -1.
    """
    w = Window.partitionBy(*group)
    rows = rows.withColumns({"back": F.row_number().over(w.orderBy(F.desc(order))), "ties": F.count("*").over(w)})
    depth = F.floor(F.log2(F.col("back").cast("double"))).cast("int")
    full = F.pow(F.lit(2.0), depth + 1) - 1 <= F.col("ties")
    return rows.withColumn("to_final", F.when(full & (depth <= most), depth).otherwise(-1)).drop("back", "ties")


def rotation_letter(number, base: int, letters: int):
    """The letter of the ``number``-th group when groups come in turn."""
    return F.chr(F.lit(65) + F.pmod(number - base, F.lit(letters)))


# Code prefixes and phase words of knock-out competitions; three places ask for different ones.
LEAGUE_CUP_CODES, GROUP_CUP_CODES, BRACKET_CODES = ("PCC", "BC"), ("PCC", "BC", "MCP", "MCB"), ("PCC", "BC", "MCPK", "MCBK")
GROUP_CUP_WORDS, BRACKET_WORDS = ("copa", "campeon", "maspalomas"), ("copa", "campeon")
BRACKET_ENDING, BRACKET_ROUND = "KO", "ronda"


def _begins(code, prefixes):
    upper = F.upper(F.coalesce(code, F.lit("")))
    return reduce(lambda x, y: x | y, [upper.startswith(p) for p in prefixes])


def _holds(phase, words):
    lower = F.lower(F.coalesce(phase, F.lit("")))
    return reduce(lambda x, y: x | y, [lower.contains(w) for w in words])


def is_league_group(code, phase):
    """Whether tables may be recomputed: no cup by the word in its phase or by its code."""
    return ~(_holds(phase, ("copa",)) | _begins(code, LEAGUE_CUP_CODES))


def is_cup_group(code, phase):
    """Whether a group stays out of league views: by its code or a word in its phase."""
    return _begins(code, GROUP_CUP_CODES) | _holds(phase, GROUP_CUP_WORDS)


def is_bracket_group(code, phase, rounds):
    """Whether a group is shown as a bracket: by code, its ending, phase, or if all its rounds are named so."""
    named = (F.size(rounds) > 0) & F.forall(rounds, lambda r: F.lower(r).contains(BRACKET_ROUND))
    return _begins(code, BRACKET_CODES) | F.upper(F.coalesce(code, F.lit(""))).endswith(BRACKET_ENDING) | _holds(phase, BRACKET_WORDS) | F.coalesce(named, F.lit(False))
