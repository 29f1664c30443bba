"""Scenarios with hand-made rows: tables, repairs, cups, merging and guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import dates, scores, text
from tallyfield.operators import cups, gates, merge, resolve, standings, stats
from tallyfield.schema import FIXTURE, STANDING

A, B, C, D = "Alpha", "Beta", "Gamma B", "Delta"


def fixtures(spark, rows, season=2025, group="g"):
    """Rows of (round, home, away, home_score, away_score), played in the order given."""
    day = dt.date(2025, 1, 1)
    return spark.createDataFrame([(i, season, group, r, day + dt.timedelta(days=i), *x) for i, (r, *x) in enumerate(rows)], FIXTURE)


def table(df):
    return [(r["team"], r["points"], r["played"], r["gd"]) for r in df.orderBy("position").collect()]


def test_league_table_breaks_ties_by_difference_goals_and_name(spark):
    rows = [(1, A, B, 2, 0), (1, C, D, 3, 1), (2, A, C, 0, 0), (2, B, D, None, None)]
    assert table(standings.league_table(fixtures(spark, rows))) == [(C, 4, 2, 2), (A, 4, 2, 2), (D, 0, 1, -2), (B, 0, 1, -2)]


def test_unplayed_fixture_gives_a_zero_row_only_if_asked(spark):
    df = fixtures(spark, [(1, A, B, 1, 0), (2, C, D, None, 3)])
    assert (C, 0, 0, 0) in table(standings.league_table(df))
    assert [r[0] for r in table(standings.league_table(df, include_unplayed=False))] == [A, B]


@pytest.mark.parametrize(("raw", "kept"), [(0, 0), (50, 50), (51, None), (-1, None), (41003, None), (None, None)])
def test_scores_outside_0_to_50_are_null(spark, raw, kept):
    row = spark.createDataFrame([(raw,)], "s int").select(scores.sane(F.col("s")).alias("s")).first()
    assert row["s"] == kept


def standing(spark, rows):
    """Rows of (position, team, points, played, won, drawn, lost)."""
    return spark.createDataFrame([(2025, "g", *r, 0, 0, 0) for r in rows], STANDING)


def test_points_are_repaired_beyond_a_sanction_and_ranked_anew(spark):
    rows = [(1, A, 2, 10, 10, 0, 0), (2, B, 21, 10, 8, 0, 2), (3, C, 99, 9, 1, 1, 1), (4, D, 15, 10, 7, 0, 3)]
    got = {r["team"]: (r["points"], r["position"]) for r in standings.repaired_points(standing(spark, rows)).collect()}
    assert got == {A: (30, 2), B: (21, 3), C: (99, 1), D: (15, 4)}


def test_order_stays_if_nothing_is_repaired(spark):
    rows = [(1, A, 3, 1, 1, 0, 0), (2, B, 9, 3, 3, 0, 0)]
    assert [r["position"] for r in standings.repaired_points(standing(spark, rows)).orderBy("team").collect()] == [1, 2]


def test_stale_table_is_recomputed_and_synced_or_cup_table_is_kept(spark):
    computed = standings.league_table(fixtures(spark, [(1, A, B, 1, 0), (2, B, A, 0, 0)]))
    stale = standing(spark, [(1, B, 3, 1, 1, 0, 0), (2, A, 0, 1, 0, 0, 1)])
    synced = standing(spark, [(1, B, 4, 2, 1, 1, 0), (2, A, 1, 2, 0, 1, 1)])
    cup = spark.createDataFrame([(2025, "g")], "season int, grp string")
    origin = lambda *a: {r["origin"] for r in standings.effective_standings(*a).collect()}
    assert origin(stale, computed) == {"computed"}
    assert origin(synced, computed) == {"published"}
    assert origin(stale, computed, cup) == {"published"}


def test_streak_is_the_trailing_run(spark):
    df = fixtures(spark, [(1, A, B, 0, 1), (2, A, C, 2, 0), (3, B, A, 0, 1), (4, A, D, None, None)])
    got = {r["team"]: r.asDict() for r in stats.current_streak(df).collect()}
    assert "W" in got[A].values() and 2 in got[A].values()
    assert D not in got or None in got[D].values()


def test_cup_champion_is_first_and_rounds_count_before_wins(spark):
    rows = [(1, A, B, 1, 1), (1, C, D, 4, 0), (2, A, C, 2, 1)]
    got = [r["team"] for r in cups.cup_ranking(fixtures(spark, rows)).orderBy("position").collect()]
    assert got[:2] == [A, C]
    assert cups.champions(fixtures(spark, rows)).first()["champion"] == A


def test_no_champion_without_a_decided_single_final(spark):
    assert cups.champions(fixtures(spark, [(1, A, B, 1, 0), (2, A, C, 1, 1)])).count() == 0
    assert cups.champions(fixtures(spark, [(1, A, B, 1, 0), (1, C, D, 1, 0)])).count() == 0


KEY = ["season", "grp", "round", "home", "away"]


def test_late_scores_fill_in_and_never_overwrite(spark):
    stored = fixtures(spark, [(1, A, B, 2, 1), (2, C, D, None, None)])
    late = fixtures(spark, [(1, A, B, 5, 5), (2, C, D, 0, 3), (3, A, D, None, None)])
    once = merge.fill_nulls(stored, late, KEY, ["home_score", "away_score"])
    got = {r["home"] + r["away"]: (r["home_score"], r["away_score"]) for r in once.collect()}
    assert got == {A + B: (2, 1), C + D: (0, 3), A + D: (None, None)}
    twice = merge.fill_nulls(once, late, KEY, ["home_score", "away_score"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_a_group_is_replaced_only_by_strictly_more_played_fixtures(spark):
    stored = fixtures(spark, [(1, A, B, 1, 0), (2, C, D, None, None)])
    same = fixtures(spark, [(1, A, B, 1, 0)])
    more = fixtures(spark, [(1, A, B, 1, 0), (2, C, D, 2, 2)])
    action = lambda load: merge.no_regression(stored, load, ["season", "grp"]).first()["action"]
    assert action(same) == "keep" and action(more) == "replace" and action(more.limit(0)) == "keep"
    assert merge.replace_groups(stored, more.limit(0), ["season", "grp"]).count() == 2
    new = fixtures(spark, [(1, A, B, None, None)], group="h")
    assert {(r["grp"], r["action"]) for r in merge.no_regression(stored, new, ["season", "grp"]).collect()} == {("g", "keep"), ("h", "replace")}


def test_last_load_wins_and_first_claim_stands(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "key string, seq int, v string")
    assert {(r["key"], r["v"]) for r in merge.last_wins(rows, ["key"], "seq").collect()} == {("k", "b"), ("m", "c")}
    kept, later = merge.first_claim(rows, ["key"], ["seq"])
    assert {r["v"] for r in kept.collect()} == {"a", "c"} and [r["v"] for r in later.collect()] == ["b"]


def test_orphans_are_cleared_inside_their_scope_only(spark):
    children = spark.createDataFrame([(1, 10, 1), (2, 99, 1), (3, 99, 2), (4, None, 1)], "id int, parent int, season int")
    parents = spark.createDataFrame([(10,)], "parent int")
    scope = spark.createDataFrame([(1,)], "season int")
    got = {r["id"]: r["parent"] for r in merge.without_orphans(children, parents, "parent", scope, "season").collect()}
    assert got == {1: 10, 2: None, 3: 99, 4: None}


def test_merged_entities_point_to_one_id_and_collisions_go(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (2, 6, "x"), (3, 7, "y")], "n int, team int, game string")
    alias = spark.createDataFrame([(6, 5)], "id int, canonical_id int")
    assert {(r["n"], r["team"]) for r in merge.repointed(rows, alias, ["team"], ["team", "game"], ["n"]).collect()} == {(1, 5), (3, 7)}


def test_quality_gates(spark):
    df = fixtures(spark, [(1, A, A, 1, 0), (2, A, B, 1, 0)])
    assert gates.self_matches(df).count() == 1
    twice = df.unionByName(df.where("round = 2"))
    assert gates.duplicates(twice, ["season", "grp", "home", "away"]).count() == 1
    bad = gates.outside(df.withColumn("kind", F.when(F.col("round") == 1, "?").otherwise("goal")), "kind", ("goal", "red"))
    assert bad.count() == 1


def test_names_of_one_club_share_a_key_and_the_letter_separates(spark):
    names = [("Club Ñandú C.F.",), ("NANDU CF",), ("Nandu B",)]
    keys = [r["k"] for r in spark.createDataFrame(names, "n string").select(text.team_key(F.col("n")).alias("k")).collect()]
    assert keys == ["nandu", "nandu", "nandu b"]


def test_reconciliation_drops_the_letter_and_reads_quotes_its_own_way(spark):
    names = [("VET “C”",), ('Vet "C"',), ("Unión S.A.D. Vet, U.D. A",), ("Vet-Sur (P)",)]
    df = spark.createDataFrame(names, "n string").select(text.reconciliation_key(F.col("n")).alias("r"), text.team_key(F.col("n")).alias("t"))
    assert [tuple(r) for r in df.collect()] == [("vet", "vet c"), ("vet", "vet c"), ("vet", "vet a"), ("vet-sur (p)", "vet-sur (p)")]


def test_dates_of_several_formats(spark):
    rows = [("2025-03-09",), ("09-03-2025",), ("09/03/2025",), ("09/03",), ("",), (None,), ("31/02/2025",)]
    got = [r["d"] for r in spark.createDataFrame(rows, "t string").select(dates.parsed_date(F.col("t")).alias("d")).collect()]
    assert got == [dt.date(2025, 3, 9)] * 3 + [None] * 4


def greedy(pairs):
    """Pairs one by one in order, each if both its names are free."""
    used, out = set(), []
    for g, a, b, score, common in sorted(pairs, key=lambda p: (p[0], -p[3], -p[4], p[1], p[2])):
        if (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            out.append((g, a, b))
    return sorted(out)


@pytest.mark.parametrize("finish", [0, 9, 20_000])
def test_assignment_takes_every_pair_it_can(spark, finish):
    """Names that all tie with each other: a round finds one pair, and none may be left at its end."""
    pairs = [(g, f"a{i}", f"b{j}", 1.0, 2) for g in ("x", "y") for i in range(4) for j in range(4)]
    pairs += [("x", "a9", "b9", 0.7, 1), ("x", "a9", "c", 0.7, 2)]  # more common tokens come before the name
    got = resolve.greedy_assignment(spark.createDataFrame(pairs, "grp string, a string, b string, score double, common int"), ("grp",), finish)
    assert sorted((r["grp"], r["a"], r["b"]) for r in got.collect()) == greedy(pairs)


@pytest.mark.parametrize("finish", [110, 20_000])
def test_assignment_follows_a_chain_of_preferences(spark, finish):
    """Each pair is free only after the one before it is taken: 60 pairs need 60 rounds."""
    pairs = [("x", f"a{i}", f"b{i}", 1 - 0.001 * (2 * i), 1) for i in range(60)] + [("x", f"a{i + 1}", f"b{i}", 1 - 0.001 * (2 * i + 1), 1) for i in range(60)]
    got = resolve.greedy_assignment(spark.createDataFrame(pairs, "grp string, a string, b string, score double, common int"), ("grp",), finish)
    assert sorted((r["grp"], r["a"], r["b"]) for r in got.collect()) == greedy(pairs)


def test_script_values_end_outside_strings(spark):
    """Brackets, semicolons and quotes inside strings do not end a value."""
    from tallyfield.sources.landed import script_value

    scripts = ['let OTHER = 1; const ROWS = [{"n": "a];b"}, {"n": "say \\"};\\" \\\\"}]; const X = [];', "const ROWS=[]", "var ROWS = [ {\"n\": null} ] ;\n"]
    got = spark.createDataFrame([(x,) for x in scripts], "t string").select(script_value(F.col("t"), "ROWS", "array<struct<n:string>>").alias("v")).collect()
    assert [[x["n"] for x in r["v"]] for r in got] == [["a];b", 'say "};" \\'], [], [None]]


def test_versions_count_on_beyond_z(spark):
    rows, other = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    today = spark.sql("select date_format(current_date(), 'yyyyMMdd') d").first()["d"]
    after = lambda v, df=other: merge.next_version(rows, df, v, ["x"]).first()["version"]
    assert [after(today + v) for v in ("", "b", "y", "z", "zb")] == [today + v for v in ("b", "c", "z", "zb", "zc")]
    assert after("20200101c") == today and after("20200101c", rows) == "20200101c"


def test_lookup_by_a_key_that_holds_another(spark):
    names = spark.createDataFrame([("Norte Mar",), ("Sur",), ("Gran Puerto Viejo",), ("abc",)], "name string")
    entries = spark.createDataFrame([("norte mar azul", 1), ("puerto", 2), ("sur", 3), ("xabcx", 4)], "name string, value int")
    got = dict(tuple(r) for r in resolve.name_lookup(names, entries, F.lower).collect())
    assert got == {"Norte Mar": 1, "Sur": 3, "Gran Puerto Viejo": 2, "abc": None}


def test_nothing_in_nothing_out(spark):
    nothing = spark.createDataFrame([], FIXTURE)
    assert standings.league_table(nothing).count() == 0
    assert cups.cup_ranking(nothing).count() == 0
    assert stats.current_streak(nothing).count() == 0
    assert merge.fill_nulls(nothing, nothing, KEY, ["home_score", "away_score"]).count() == 0


def test_rules_of_a_tournament(spark):
    """A sound tournament breaks none; a lost match, a repeated pair and a lesser knock-out with the best teams do."""
    from tallyfield.operators import cups

    legs = [(0, 1), (2, 3), (0, 2), (1, 3), (0, 3), (1, 2)]
    stage = lambda t: [(t, 2 * i + g, f"{'AB'[g]}{x}", f"{'AB'[g]}{y}", 2, 1) for i, (x, y) in enumerate(legs) for g in (0, 1)]
    low, high = ("A2", "B3", "A3", "B2"), ("A0", "B1", "A1", "B0")
    cup = lambda t, n, who: [(t, n, who[0], who[1], None, None), (t, n + 1, who[2], who[3], None, None), (t, n + 2, who[0], who[2], None, None)]
    lost = [m for m in stage("lost") if m[1] != 11]
    twice = [m if m[1] != 4 else ("twice", 4, "A1", "A0", 1, 1) for m in stage("twice")]
    rows = stage("sound") + cup("sound", 20, low) + cup("sound", 30, high) + lost + twice + cup("twice", 20, low) + stage("turned") + cup("turned", 20, high) + cup("turned", 30, low)
    schema = "t string, number int, home string, away string, home_score int, away_score int"
    found = cups.tournament_faults(spark.createDataFrame(rows, schema), 2, 4, 2, ("t",)).collect()
    assert sorted((r["t"], r["fault"], r["place"], r["found"], r["expected"]) for r in found) == [
        ("lost", "matches", "B", 5, 6), ("lost", "pairs", "B", 5, 6), ("lost", "stage", None, 11, 12), ("turned", "seeding", None, 1, 2), ("twice", "cups", None, 1, 2), ("twice", "pairs", "A", 5, 6),
    ]
    assert cups.tournament_faults(spark.createDataFrame([], schema), 2, 4, 2, ("t",)).count() == 0
