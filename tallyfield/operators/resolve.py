"""Telling which names, fixtures and groups are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.arrays import let
from tallyfield.functions.text import core_tokens, filial
from tallyfield.session import written

# The scores and lengths from which names count as the same.
SAME_NAME, LONG_PREFIX, SHORT_PREFIX, LONG_TOKEN = 0.6, 6, 2, 5
ONE_FILIAL = 0.85
SAME_LEAGUE = 0.5
#: Pairs that may be left to one task for each group.
FEW_PAIRS = 20_000
# Rows of one key that meet in one cell when a frequent key is paired.
PAIR_BLOCK = 1024


def common_tokens(a: Column, b: Column) -> Column:
    """How many tokens of two arrays of distinct tokens pair up.

    They do if equal, then if one begins with the other and the shorter has six letters, and, once something
    paired, with two letters; every token pairs once, in order.
    """
    start = F.struct(F.size(F.array_intersect(a, b)).alias("n"), F.array_sort(F.array_except(a, b)).alias("a"), F.array_sort(F.array_except(b, a)).alias("b"))

    def paired(state: Column, least: int) -> Column:
        """Pair tokens of state.a, in order, with the first token of state.b they share a beginning with."""

        def step(s: Column, token: Column) -> Column:
            fit = F.filter(s["b"], lambda t: (t.startswith(token) | token.startswith(t)) & (F.least(F.length(t), F.length(token)) >= least))
            return let(F.get(fit, F.lit(0)), lambda t: taken(s, token, t))

        def taken(s: Column, token: Column, t: Column) -> Column:
            return F.struct(
                (s["n"] + t.isNotNull().cast("int")).alias("n"),
                F.when(t.isNotNull(), s["a"]).otherwise(F.concat(s["a"], F.array(token))).alias("a"),
                F.when(t.isNotNull(), F.filter(s["b"], lambda x: x != t)).otherwise(s["b"]).alias("b"),
            )

        return F.aggregate(state["a"], F.struct(state["n"].alias("n"), F.array().cast("array<string>").alias("a"), state["b"].alias("b")), step)

    then = lambda long: F.when((long["n"] > 0) & (F.size(long["a"]) > 0) & (F.size(long["b"]) > 0), paired(long, SHORT_PREFIX)["n"]).otherwise(long["n"])
    return let(start, lambda s: F.when((F.size(s["a"]) > 0) & (F.size(s["b"]) > 0), let(paired(s, LONG_PREFIX), then)).otherwise(s["n"]))


def _score(common: Column, size_a: Column, size_b: Column, filial_a: Column, filial_b: Column) -> Column:
    small, large = F.least(size_a, size_b), F.greatest(size_a, size_b)
    base = F.when(small > 0, common / small * (F.lit(0.5) + F.lit(0.5) * common / large)).otherwise(F.lit(0.0))
    alone = filial_a.isNull() != filial_b.isNull()
    return F.when(filial_a != filial_b, F.lit(0.0)).when(alone, base * ONE_FILIAL).otherwise(base)


def token_match(a: Column, b: Column, filial_a: Column, filial_b: Column) -> Column:
    """struct<score, common> for two arrays of distinct tokens and the letters after the names.

    Different letters give 0.  The score, 0 .. 1, is common / smaller x (0.5 + 0.5 common / larger), with the tokens
    that pair up in common, and a little less if only one has a letter.
    """
    return let(common_tokens(a, b), lambda c: F.struct(_score(c, F.size(a), F.size(b), filial_a, filial_b).alias("score"), c.alias("common")))


def name_score(a: Column, b: Column) -> Column:
    return token_match(core_tokens(a), core_tokens(b), filial(a), filial(b))["score"]


def names_match(a: Column, b: Column) -> Column:
    """Whether two reconciliation keys name the same team.

    Equal; or one begins with the other and the shorter has five letters; or all words of one are in the
    other, at least two and one of five letters; or two words are shared and one has five letters.  Words of
    one letter do not count.
    """
    x, y = (F.array_distinct(F.filter(F.split(n, " "), lambda w: F.length(w) >= 2)) for n in (a, b))
    both = F.array_intersect(x, y)
    prefix = (a.startswith(b) | b.startswith(a)) & (F.least(F.length(a), F.length(b)) >= LONG_TOKEN)
    long = F.exists(both, lambda t: F.length(t) >= LONG_TOKEN)
    subset = (F.size(both) == F.least(F.size(x), F.size(y))) & (F.size(both) >= 2)
    return (a == b) | prefix | ((subset | (F.size(both) >= 2)) & long)


def _tokens(names: DataFrame, group: tuple[str, ...], c: str) -> DataFrame:
    """Distinct names with their tokens, the beginnings of those, and their letter, each worked out once."""
    name = F.col("name")
    once = names.select(*group, "name").where(name.isNotNull()).distinct()
    once = once.select(*group, name.alias(c), core_tokens(name).alias(f"{c}_tokens"), filial(name).alias(f"{c}_filial"))
    return once.withColumn(f"{c}_starts", F.transform(f"{c}_tokens", lambda w: F.substring(w, 1, SHORT_PREFIX)))


def scored_pairs(left: DataFrame, right: DataFrame, group: tuple[str, ...] = (), least: float = SAME_NAME, beside: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, score, common) of the names of (group, name) in two tables that score at least ``least``; never a cross join.

    Only names that share the beginning of a token meet, each pair at the first beginning that both have.  How many
    tokens share their beginnings bounds the score, so most pairs are dropped before it is worked out.  ``beside``
    are further columns of the left side, a part of what tells its names apart.
    """
    a, b = written(_tokens(left, (*group, *beside), "a"), "tokens"), written(_tokens(right, group, "b"), "tokens")
    met = a.withColumn("k", F.explode(F.array_distinct("a_starts"))).join(b.withColumn("k", F.explode(F.array_distinct("b_starts"))), [*group, "k"])
    met = met.where(F.col("k") == F.array_min(F.array_intersect("a_starts", "b_starts")))
    at_most = lambda x, y: F.size(F.filter(x, lambda p: F.array_contains(y, p)))
    bound = F.least(at_most(F.col("a_starts"), F.col("b_starts")), at_most(F.col("b_starts"), F.col("a_starts")))
    letters = F.col("a_filial").isNull() | F.col("b_filial").isNull() | (F.col("a_filial") == F.col("b_filial"))
    likely = met.where(letters & (_score(bound, F.size("a_tokens"), F.size("b_tokens"), F.lit(None), F.lit(None)) >= least))
    scored = likely.withColumn("m", token_match(F.col("a_tokens"), F.col("b_tokens"), F.col("a_filial"), F.col("b_filial")))
    return scored.where(F.col("m.score") >= least).select(*group, *beside, "a", "b", "m.score", "m.common")


def greedy_assignment(pairs: DataFrame, group: tuple[str, ...] = (), finish: int = FEW_PAIRS) -> DataFrame:
    """One-to-one pairs, best score first; more ``common`` tokens (if pairs have them), then names break ties.

    Pairs that are the best of both their sides belong to the greedy choice; taking them and dropping what
    they use up, again and again, gives all of it.  Every round takes at least one pair of each group that
    has any.  Once no more than ``finish`` pairs are left they are read in that order, each group by one task,
    which gives the same pairs in fewer jobs.
    """
    order = (F.desc("score"), *([F.desc("common")] if "common" in pairs.columns else []), F.asc("a"), F.asc("b"))
    chosen, rest = None, written(pairs, "pairs")
    while (left := rest.count()) > finish:
        best = rest.withColumns({"x": F.row_number().over(Window.partitionBy(*group, "a").orderBy(*order)), "y": F.row_number().over(Window.partitionBy(*group, "b").orderBy(*order))})
        taken = written(best.where("x = 1 and y = 1").drop("x", "y"), "assigned")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        rest = rest.join(taken.select(*group, "a"), [*group, "a"], "left_anti").join(taken.select(*group, "b"), [*group, "b"], "left_anti")
        rest = written(rest, "pairs")
    if chosen is not None and not left:
        return chosen
    dealt = rest.repartition(*group) if group else rest.coalesce(1)
    last = dealt.sortWithinPartitions(*group, *order).mapInPandas(_first_come(list(group)), rest.schema)
    return last if chosen is None else chosen.unionByName(last)


def _first_come(group: list[str]):
    """Of pairs in order, those of which neither name was taken before in their group."""

    def taken(parts):
        used = (set(), set())
        for part in parts:
            keep = []
            for *g, a, b in zip(*(part[c] for c in [*group, "a", "b"]), strict=True):
                a, b = (*g, a), (*g, b)
                keep.append(a not in used[0] and b not in used[1])
                if keep[-1]:
                    used[0].add(a)
                    used[1].add(b)
            yield part[keep]

    return taken


def forced_last_pair(left: DataFrame, right: DataFrame, assigned: DataFrame, group: tuple[str, ...], least: int = 3) -> DataFrame:
    """The assignment with one more pair for groups where ``least`` matched and one name is left on either side."""
    left_over = lambda t, c: t.join(assigned.select(*group, F.col(c).alias("name")), [*group, "name"], "left_anti").groupBy(*group).agg(F.count("*").alias("n"), F.first("name").alias(c)).where("n = 1").drop("n")
    enough = assigned.groupBy(*group).agg(F.count("*").alias("m")).where(F.col("m") >= least).drop("m")
    last = left_over(left, "a").join(left_over(right, "b"), list(group)).join(enough, list(group))
    return assigned.unionByName(last.withColumn("score", F.lit(0.0)), allowMissingColumns=True)


def canonical_names(scraped: DataFrame, group_teams: DataFrame, season_teams: DataFrame) -> DataFrame:
    """season, grp, name, canonical, stage: the stored name that each scraped name of (season, grp, name) is to have.

    Names of one group with the same tokens and letter are variants; their smallest stands for them.  First they are
    assigned to the group's roster (``group_teams``: season, grp, name); where three or more matched and one is left on
    either side, those two belong together.  What is loose then is assigned to the season's teams (``season_teams``:
    season, name) without those that the group has used and without names that were scraped as they are in the group.
    Who finds no one keeps the name that stands for its variants.  Null names are left out.
    """
    by = ("season", "grp")
    name = F.col("name")
    key = F.struct(F.array_sort(core_tokens(name)).alias("tokens"), filial(name).alias("filial"))
    own = scraped.where(name.isNotNull()).select(*by, "name").distinct().withColumn("key", key)
    own = written(own.withColumn("stands", F.min("name").over(Window.partitionBy(*by, "key"))), "variants")
    standing = own.select(*by, F.col("stands").alias("name")).distinct()
    roster = group_teams.where(name.isNotNull()).select(*by, "name").distinct()
    assigned = written(greedy_assignment(scored_pairs(standing, roster, by), by).select(*by, "a", "b").withColumn("stage", F.lit("roster")), "assigned")
    assigned = written(forced_last_pair(standing, roster, assigned.withColumn("score", F.lit(1.0)), by).select(*by, "a", "b", F.coalesce("stage", F.lit("last pair")).alias("stage")), "assigned")
    loose = standing.join(assigned.select(*by, F.col("a").alias("name")), [*by, "name"], "left_anti")
    pairs = scored_pairs(loose, season_teams, ("season",), beside=("grp",))
    pairs = pairs.join(assigned.select(*by, "b"), [*by, "b"], "left_anti").join(own.select(*by, F.col("name").alias("b")), [*by, "b"], "left_anti")
    later = greedy_assignment(pairs.select(*by, "a", "b", "score", "common"), by).select(*by, "a", "b", F.lit("season").alias("stage"))
    found = assigned.unionByName(later).withColumnRenamed("a", "stands")
    named = own.join(found, [*by, "stands"], "left")
    return named.select(*by, "name", F.coalesce("b", "stands").alias("canonical"), F.coalesce("stage", F.lit("own")).alias("stage"))


def same_league(pages: DataFrame, stored: DataFrame, group: tuple[str, ...], least: float = SAME_LEAGUE) -> DataFrame:
    """Whether the page of each group still shows the league that is stored: n_page, n_stored, overlap and state.

    Both inputs hold ``group`` and ``name``.  The overlap is the number of names that can be assigned one to one, over the
    smaller number of names; from ``least`` on the state is ``same``, below it ``other``.  A group without names on its
    page is ``no table`` and has no overlap; one without stored names overlaps by 0.  Null and repeated names do not count.
    """
    named = lambda t: t.where(F.col("name").isNotNull()).select(*group, "name").distinct()
    number = lambda t, c: t.groupBy(*group).agg(F.count("*").alias(c))
    page, own, by = named(pages), named(stored), list(group)
    matched = number(greedy_assignment(scored_pairs(page, own, group), group), "matched")
    rows = number(own, "n_stored").join(number(page, "n_page"), by, "full").join(matched, by, "left")
    rows = rows.withColumn("overlap", F.when(F.col("n_page").isNotNull(), F.coalesce("matched", F.lit(0)) / F.least("n_page", "n_stored")))
    state = F.when(F.col("n_page").isNull(), "no table").when(F.col("overlap") >= least, "same").otherwise("other")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(*group, count("n_page"), count("n_stored"), "overlap", state.alias("state"))


def _name_blocks(name: Column) -> Column:
    """Keys of which two names that :func:`names_match` brings together share at least one.

    Names that match are equal, or begin with the same five letters, or share two words of which one is long.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(name, " "), lambda w: F.length(w) >= 2)))
    long = lambda w: F.length(w) >= LONG_TOKEN
    pairs = F.flatten(F.transform(words, lambda x: F.transform(F.filter(words, lambda y: (y > x) & (long(x) | long(y))), lambda y: F.concat(x, F.lit(" "), y))))
    start = F.when(F.length(name) >= LONG_TOKEN, F.substring(name, 1, LONG_TOKEN)).otherwise(name)
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("^"), start)), pairs))


def matching_names(left: DataFrame, right: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (a, b) reconciliation keys of one group that name the same team; (name) in, blocked, never a cross join."""
    key = lambda t, n: t.select(*group, F.col("name").alias(n)).where(F.length(n) > 0).distinct().withColumn("k", F.explode(_name_blocks(F.col(n))))
    pairs = key(left, "a").join(key(right, "b"), [*group, "k"]).select(*group, "a", "b").distinct()
    return pairs.where(names_match(F.col("a"), F.col("b")))


def equal_pairs(rows: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """All (id, other) with id < other of rows of (id, key) that have one key; null keys pair with none.

    A key's rows are dealt by a hash of their id over parts of about ``block`` rows, and each two parts (and each part
    with itself) meet in a cell of their own: no task has to pair a frequent key alone.  Parts are sent to as many cells
    as their key has parts, which is one for all but frequent keys.
    """
    frequent = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    dealt = rows.join(frequent, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    first = dealt.select("key", "id", F.col("part").alias("p"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("q"))
    second = dealt.select("key", F.col("id").alias("other"), F.explode(F.sequence(F.lit(0), "part")).alias("p"), F.col("part").alias("q"))
    cells, by = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["key", "p", "q"]
    met = first.repartition(cells, *by).join(second.repartition(cells, *by).hint("merge"), by)
    met = met.where((F.col("id") != F.col("other")) & ((F.col("p") < F.col("q")) | (F.col("id") < F.col("other"))))
    return met.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"))


def reconcile(reports: DataFrame, fixtures: DataFrame, group: tuple[str, ...] = (), days: int = 1) -> DataFrame:
    """The one fixture each report is about, or null.

    Both have home_key, away_key (reconciliation keys), match_date, home_score, away_score and ``group``;
    reports have report_id, fixtures match_id.  Candidates are fixtures of the group whose names match by
    :func:`names_match`.  A single candidate stands unless its day (by more than ``days``) or its score says
    otherwise; several are narrowed by day if any fits, then by score; what is not unique then is nobody.
    """
    named = lambda t, c: t.select(*group, F.col(c).alias("name"))
    names = lambda side: matching_names(named(reports, side), named(fixtures, side), group).select(*group, F.col("a").alias(side), F.col("b").alias(f"f_{side}"))
    f = fixtures.select(*group, "match_id", *[F.col(c).alias(f"f_{c}") for c in ("home_key", "away_key", "match_date", "home_score", "away_score")])
    pairs = reports.join(names("home_key"), [*group, "home_key"]).join(names("away_key"), [*group, "away_key"]).join(f, [*group, "f_home_key", "f_away_key"])
    dated = F.col("match_date").isNotNull() & F.col("f_match_date").isNotNull()
    scored = F.col("home_score").isNotNull() & F.col("away_score").isNotNull() & F.col("f_home_score").isNotNull() & F.col("f_away_score").isNotNull()
    day = F.when(dated, F.abs(F.date_diff("match_date", "f_match_date")) <= days)
    score = F.when(scored, (F.col("home_score") == F.col("f_home_score")) & (F.col("away_score") == F.col("f_away_score")))
    pairs = pairs.select("report_id", "match_id", day.alias("day"), score.alias("score"))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    only = lambda cond: (F.count_if(cond), F.min(F.when(cond, F.col("match_id"))))
    by_day, by_score, by_both = only(true("day")), only(true("score")), only(true("day") & true("score"))
    agg = pairs.groupBy("report_id").agg(
        F.count("*").alias("n"),
        F.first("match_id").alias("only"),
        F.first(F.coalesce(F.col("day"), F.lit(True)) & F.coalesce(F.col("score"), F.lit(True))).alias("fits"),
        *[x.alias(name) for pair, names_ in ((by_day, ("n_day", "by_day")), (by_score, ("n_score", "by_score")), (by_both, ("n_both", "by_both"))) for x, name in zip(pair, names_, strict=True)],
    )
    found = F.when(F.col("n") == 1, F.when(F.col("fits"), F.col("only"))).when(F.col("n_day") == 1, F.col("by_day"))
    found = found.when((F.col("n_day") == 0) & (F.col("n_score") == 1), F.col("by_score")).when((F.col("n_day") > 1) & (F.col("n_both") == 1), F.col("by_both"))
    return reports.select("report_id").join(agg.select("report_id", found.alias("match_id")), "report_id", "left")


def colliding(teams: DataFrame, listed: DataFrame) -> DataFrame:
    """Teams of (key, id, name, last_season, played) that are one club under several names: (stays, goes) pairs.

    Of equal keys the team of the newest season stays, then the one with most matches, then by name.  Keys
    with two teams that are listed in one group (listed: (grp, id)) are different clubs and left alone.
    """
    keyed = listed.select("grp", "id").distinct().join(teams.select("id", "key"), "id")
    together = keyed.groupBy("key", "grp").agg(F.count("*").alias("n")).where("n > 1").select("key").distinct()
    order = Window.partitionBy("key").orderBy(F.desc_nulls_last("last_season"), F.desc_nulls_last("played"), "name", "id")
    rows = teams.join(together, "key", "left_anti").withColumns({"n": F.row_number().over(order), "stays": F.first("id").over(order)})
    return rows.where("n > 1").select("key", "stays", F.col("id").alias("goes"))


def quarantined(reports: DataFrame, assigned: DataFrame) -> DataFrame:
    """Reports (report_id, home_key, away_key) that no fixture took, with the reason; ``assigned``: (report_id, match_id).

    A report without a team's name, one without a match, and one that came to a match after another report
    (by report_id) are told apart.
    """
    turn = F.row_number().over(Window.partitionBy("match_id").orderBy("report_id"))
    claims = assigned.where("match_id is not null").withColumn("turn", turn).select("report_id", "turn")
    nameless = (F.length(F.coalesce("home_key", F.lit(""))) == 0) | (F.length(F.coalesce("away_key", F.lit(""))) == 0)
    reason = F.when(nameless, "no names").when(F.col("turn").isNull(), "no match").when(F.col("turn") > 1, "match taken")
    return reports.join(claims, "report_id", "left").withColumn("reason", reason).where("reason is not null").select("report_id", "reason")


def reassigned(before: DataFrame, after: DataFrame) -> DataFrame:
    """Matches (match_id, report_id) whose report belongs elsewhere now, and what they hold instead: ``after`` wins.

    A match keeps its report unless ``after`` gives that report to another match; then it is cleared.
    """
    new = after.select("report_id", F.col("match_id").alias("now"))
    moved = before.join(new, "report_id").where("match_id <> now").select("match_id", F.col("report_id").alias("cleared"))
    taken = after.select("match_id", F.col("report_id").alias("given"))
    return moved.join(taken, "match_id", "left").select("match_id", "cleared", "given")


def canonical_ids(names: DataFrame) -> DataFrame:
    """(id, key) to the smallest id of each key: the row an entity is known by."""
    return names.groupBy("key").agg(F.min("id").alias("canonical_id"), F.count("*").alias("spellings"))


def set_overlap(sets: DataFrame, group: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """Pairs of sets (set_id, item) of a group with the shared items over the smaller set's size."""
    rows = sets.select(*group, "set_id", "item").distinct()
    size = rows.groupBy(*group, "set_id").agg(F.count("*").alias("size"))
    other = rows.withColumnRenamed("set_id", "other_id")
    shared = rows.join(other, [*group, "item"]).where("set_id < other_id").groupBy(*group, "set_id", "other_id").agg(F.count("*").alias("shared"))
    out = shared.join(size, [*group, "set_id"]).join(size.select(*group, F.col("set_id").alias("other_id"), F.col("size").alias("other_size")), [*group, "other_id"])
    return out.withColumn("overlap", F.col("shared") / F.least("size", "other_size")).where(F.col("overlap") >= least)


def duplicate_groups(sets: DataFrame, played: DataFrame, least: float = 0.9, least_rows: int = 10) -> DataFrame:
    """Groups (set_id) whose schedule is another's: which goes and which stays (more played, then smaller id)."""
    pairs = set_overlap(sets, least=least).where((F.col("size") >= least_rows) & (F.col("other_size") >= least_rows))
    p = lambda c, n: played.select(F.col("set_id").alias(c), F.col("played").alias(n))
    both = pairs.join(p("set_id", "x"), "set_id", "left").join(p("other_id", "y"), "other_id", "left")
    first = F.coalesce("x", F.lit(0)) >= F.coalesce("y", F.lit(0))
    return both.select(F.when(first, F.col("set_id")).otherwise(F.col("other_id")).alias("stays"), F.when(first, F.col("other_id")).otherwise(F.col("set_id")).alias("goes"), "overlap")


def best_groups(rosters: DataFrame, schedules: DataFrame, least_schedule: float = 0.7, least_roster: float = 0.6) -> DataFrame:
    """For scraped groups, the stored group with the largest roster overlap whose schedule overlaps enough.

    Both inputs: (scraped, stored, overlap), one row per pair.
    """
    both = rosters.withColumnRenamed("overlap", "roster").join(schedules.withColumnRenamed("overlap", "schedule"), ["scraped", "stored"])
    best = both.where(F.col("schedule") >= least_schedule).groupBy("scraped").agg(F.max_by(F.struct("stored", "roster", "schedule"), F.struct("roster", "schedule", F.col("stored"))).alias("b"))
    return best.select("scraped", "b.*").where(F.col("roster") >= least_roster)


def withdrawn(schedule: DataFrame, table: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Teams of the schedule that the table does not have."""
    return schedule.select(*group, "team").distinct().join(table.select(*group, "team"), [*group, "team"], "left_anti")


def without_withdrawn_scores(fixtures: DataFrame, gone: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Fixtures of withdrawn teams stay, their scores go."""
    mark = lambda c: gone.select(*group, F.col("team").alias(c), F.lit(True).alias(f"{c}_gone"))
    both = fixtures.join(mark("home"), [*group, "home"], "left").join(mark("away"), [*group, "away"], "left")
    gone_ = F.coalesce("home_gone", "away_gone", F.lit(False))
    return both.withColumns({c: F.when(~gone_, F.col(c)) for c in ("home_score", "away_score")}).drop("home_gone", "away_gone")


def name_lookup(names: DataFrame, entries: DataFrame, key, least: int = 4, order: str = "name") -> DataFrame:
    """An entry's value for each name: by equal name, by equal key, else the first whose key holds or is held.

    ``entries`` is (name, value) and has ``order``, the column by which one entry comes before another; an empty key
    equals none.  Of two keys the one that is held, of at least ``least`` letters, begins with
    ``least`` letters that occur in the other: the last step joins on those.
    """
    e = entries.withColumn("key", key(F.col("name"))).withColumn("turn", F.struct(order, "name"))
    exact = e.groupBy("name").agg(F.min_by("value", "turn").alias("exact"))
    by_key = e.where("key <> ''").groupBy("key").agg(F.min_by("value", "turn").alias("by_key"))
    rows = names.withColumn("key", key(F.col("name"))).join(exact, "name", "left").join(by_key, "key", "left")
    open_ = rows.where("exact is null and by_key is null").select("name", "key").distinct().where(F.length("key") >= least)
    other = e.select(F.col("key").alias("e_key"), "value", "turn").where(F.length("e_key") >= least)
    begin = lambda t, c: t.withColumn("k", F.substring(c, 1, least))
    within = lambda t, c: t.withColumn("k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(F.col(c), i, F.lit(least))))))
    held = begin(open_, "key").join(within(other, "e_key"), "k").where(F.col("e_key").contains(F.col("key")))
    holds = within(open_, "key").join(begin(other, "e_key"), "k").where(F.col("key").contains(F.col("e_key")))
    part = held.unionByName(holds).groupBy("name").agg(F.min_by("value", "turn").alias("part"))
    return rows.join(part, "name", "left").select("name", F.coalesce("exact", "by_key", "part").alias("value"))
