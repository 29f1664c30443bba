"""Queries on tables, statistics and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions import scores
from tallyfield.operators import gates, standings, stats
from tallyfield.plans.binding import FIXTURES_SQL, TABLE_SQL, fixtures, published_standings, raw_fixtures, table
from tallyfield.plans.registry import query
from tallyfield.session import written

ORDER_SQL = "match_date, match_id, home, away, home_score, away_score"
ORDER_DESC = "match_date DESC, match_id DESC, home DESC, away DESC, home_score DESC, away_score DESC"
PLAYED = "home_score IS NOT NULL AND away_score IS NOT NULL"
TODAY = "2000-07-01"


def league(spark, sf_dir):
    return standings.league_table(fixtures(spark, sf_dir))


def kept_league(spark, sf_dir):
    """The computed tables written once: a few rows per group that several steps read, so fixtures are joined once."""
    return written(league(spark, sf_dir), "league")


def published(spark, sf_dir):
    return published_standings(league(spark, sf_dir))


@query(f"WITH {TABLE_SQL} SELECT * FROM league")
def league_table(spark, sf_dir):
    return league(spark, sf_dir)


@query(
    f"""WITH {FIXTURES_SQL}, t AS (SELECT season, grp, team, CAST(sum(pts) AS INT) points, CAST(count(*) AS INT) played, CAST(sum(gf) AS INT) gf, CAST(sum(ga) AS INT) ga
    FROM results WHERE result IS NOT NULL GROUP BY season, grp, team)
    SELECT season, grp, CAST(row_number() OVER (PARTITION BY season, grp ORDER BY points DESC, gf - ga DESC, gf DESC, team) AS INT) AS position, team, points, played FROM t"""
)
def league_table_played_only(spark, sf_dir):
    return standings.league_table(fixtures(spark, sf_dir), include_unplayed=False).select("season", "grp", "position", "team", "points", "played")


@query(f"WITH {FIXTURES_SQL} SELECT season, grp, team, CAST(sum(gf) AS INT) gf, CAST(sum(ga) AS INT) ga FROM results WHERE result IS NOT NULL AND team IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000) GROUP BY season, grp, team")
def goals_for_against(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    known = table(spark, sf_dir, "nation").join(rich, "n_nationkey", "left_semi").select(F.col("n_name").alias("team"))
    return standings.goals_for_against(fixtures(spark, sf_dir), known)


@query(
    f"""WITH {TABLE_SQL}, g AS (SELECT season, grp, team, CAST(sum(gf) AS INT) gf, CAST(sum(ga) AS INT) ga FROM results WHERE result IS NOT NULL AND grp <> 'ASIA' GROUP BY season, grp, team)
    SELECT p.season, p.grp, p.team, p.points, coalesce(g.gf, 0) gf, coalesce(g.ga, 0) ga, coalesce(g.gf, 0) - coalesce(g.ga, 0) gd FROM published p LEFT JOIN g USING (season, grp, team)"""
)
def classification_with_goals(spark, sf_dir):
    rows = fixtures(spark, sf_dir).where("grp <> 'ASIA'")
    goals = standings.goals_for_against(rows, table(spark, sf_dir, "nation").select(F.col("n_name").alias("team")))
    return standings.with_goals(published(spark, sf_dir), goals).select("season", "grp", "team", "points", "gf", "ga", "gd")


_REPAIR = """fixed AS (SELECT *, (played = won + drawn + lost AND abs(points - (3 * won + drawn)) > 6) AS repaired,
    CAST(CASE WHEN played = won + drawn + lost AND abs(points - (3 * won + drawn)) > 6 THEN 3 * won + drawn ELSE points END AS INT) AS p2 FROM {src}),
    ranked AS (SELECT season, grp, team, p2 AS points, played, repaired, CASE WHEN bool_or(repaired) OVER (PARTITION BY season, grp)
    THEN CAST(row_number() OVER (PARTITION BY season, grp ORDER BY p2 DESC, gd DESC, gf DESC, team) AS INT) ELSE position END AS position {more} FROM fixed)"""


@query(f"WITH {TABLE_SQL}, {_REPAIR.format(src='published', more='')} SELECT season, grp, position, team, points, played, repaired FROM ranked")
def repair_points(spark, sf_dir):
    return standings.repaired_points(published(spark, sf_dir)).select("season", "grp", "position", "team", "points", "played", "repaired")


@query(
    f"""WITH {TABLE_SQL}, c AS (SELECT season, grp, sum(l.played) > sum(p.played) AS recount FROM league l JOIN published p USING (season, grp, team) GROUP BY season, grp),
    cups AS (SELECT DISTINCT season, grp FROM league WHERE grp = 'ASIA'),
    choice AS (SELECT c.season, c.grp, c.recount AND cups.grp IS NULL AS recount FROM c LEFT JOIN cups USING (season, grp)),
    src AS (SELECT p.*, 'published' AS origin FROM published p JOIN choice USING (season, grp) WHERE NOT recount UNION ALL SELECT l.*, 'computed' FROM league l JOIN choice USING (season, grp) WHERE recount),
    {_REPAIR.format(src='src', more=', origin')} SELECT season, grp, position, team, points, played, origin FROM ranked"""
)
def effective_standings(spark, sf_dir):
    computed = kept_league(spark, sf_dir)
    cups = computed.where("grp = 'ASIA'").select("season", "grp").distinct()
    return standings.effective_standings(published_standings(computed), computed, cups).select("season", "grp", "position", "team", "points", "played", "origin")


@query(
    f"""WITH {TABLE_SQL} SELECT season, grp, team, p.played told_played, p.points told_points, l.played counted_played, l.points counted_points
    FROM published p JOIN league l USING (season, grp, team) WHERE p.played <> l.played OR p.points <> l.points"""
)
def table_divergence(spark, sf_dir):
    computed = kept_league(spark, sf_dir)
    return standings.divergence(published_standings(computed), computed)


@query(
    f"""WITH {TABLE_SQL}, ph AS (SELECT season, grp, CASE WHEN grp IN ('ASIA', 'EUROPE') THEN 'A' ELSE 'B' END AS phase, count(*) teams, min(CASE grp WHEN 'AFRICA' THEN 1 WHEN 'AMERICA' THEN 2 WHEN 'ASIA' THEN 3 WHEN 'EUROPE' THEN 4 ELSE 5 END) first_seen FROM league GROUP BY season, grp),
    sz AS (SELECT season, phase, sum(teams) teams, min(first_seen) fs FROM ph GROUP BY season, phase),
    best AS (SELECT season, phase FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY teams DESC, fs, phase DESC) i FROM sz) WHERE i = 1),
    main AS (SELECT season, grp FROM (SELECT ph.season, ph.grp, row_number() OVER (PARTITION BY ph.season ORDER BY first_seen, ph.grp) i FROM ph JOIN best USING (season, phase)) WHERE i <= 3)
    SELECT season, CAST(row_number() OVER (PARTITION BY season ORDER BY ppg DESC, points DESC, gd DESC, team, grp) AS INT) AS rank, team, grp, ppg, points, gd
    FROM (SELECT l.*, CASE WHEN played > 0 THEN round(points / played, 2) ELSE 0 END ppg FROM league l JOIN main USING (season, grp))"""
)
def unified_ppg(spark, sf_dir):
    computed = kept_league(spark, sf_dir)
    seen = F.create_map(*[F.lit(x) for p in (("AFRICA", 1), ("AMERICA", 2), ("ASIA", 3), ("EUROPE", 4)) for x in p])
    phases = computed.groupBy("season", "grp").agg(F.count("*").alias("teams")).withColumns(
        {"phase": F.when(F.col("grp").isin("ASIA", "EUROPE"), "A").otherwise("B"), "first_seen": F.coalesce(seen[F.col("grp")], F.lit(5))}
    )
    return standings.points_per_game(computed, phases)


@query(
    f"""WITH {FIXTURES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY season, grp, team ORDER BY {ORDER_DESC}) n FROM results WHERE result IS NOT NULL),
    l AS (SELECT season, grp, team, result last FROM r WHERE n = 1)
    SELECT r.season, r.grp, r.team, last AS streak, CAST(coalesce(min(CASE WHEN result <> last THEN n END), max(n) + 1) - 1 AS INT) AS length FROM r JOIN l USING (season, grp, team) GROUP BY ALL"""
)
def current_streak(spark, sf_dir):
    return stats.current_streak(fixtures(spark, sf_dir))


@query(
    f"""WITH {FIXTURES_SQL} SELECT season, grp, team, CAST(row_number() OVER w AS INT) seq, CAST(sum(pts) OVER (w ROWS UNBOUNDED PRECEDING) AS INT) total
    FROM results WHERE result IS NOT NULL WINDOW w AS (PARTITION BY season, grp, team ORDER BY {ORDER_SQL})"""
)
def points_history(spark, sf_dir):
    return stats.points_history(fixtures(spark, sf_dir))


@query(
    f"""WITH {FIXTURES_SQL}, h AS (SELECT season, grp, team, row_number() OVER w seq, sum(pts) OVER (w ROWS UNBOUNDED PRECEDING) total
    FROM results WHERE result IS NOT NULL WINDOW w AS (PARTITION BY season, grp, team ORDER BY {ORDER_SQL}))
    SELECT season, grp, team, string_agg(CAST(total AS VARCHAR), ',' ORDER BY seq) AS curve FROM h GROUP BY ALL"""
)
def points_curve(spark, sf_dir):
    return stats.points_curve(fixtures(spark, sf_dir)).select("season", "grp", "team", F.concat_ws(",", F.col("points_history").cast("array<string>")).alias("curve"))


@query(
    f"""WITH {FIXTURES_SQL}, h AS (SELECT season, grp, team, row_number() OVER w seq, sum(pts) OVER (w ROWS UNBOUNDED PRECEDING) total
    FROM results WHERE result IS NOT NULL WINDOW w AS (PARTITION BY season, grp, team ORDER BY {ORDER_SQL})),
    m AS (SELECT *, min(total) OVER w lo, max(total) OVER w hi, max(seq) OVER w last FROM h WINDOW w AS (PARTITION BY season, grp, team))
    SELECT season, grp, team, CAST(seq AS INT) seq, round(CASE WHEN last > 1 THEN (seq - 1) * 100 / (last - 1) ELSE 0 END, 2) x, round(CASE WHEN hi > lo THEN 20 - (total - lo) * 20 / (hi - lo) ELSE 10 END, 2) y FROM m"""
)
def sparkline(spark, sf_dir):
    return stats.sparkline(stats.points_history(fixtures(spark, sf_dir)))


def _form(by_round: bool) -> str:
    order = ("round DESC, " if by_round else "") + ORDER_DESC
    return f"""WITH {FIXTURES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY season, grp, team ORDER BY {order}) n FROM results WHERE result IS NOT NULL)
    SELECT season, grp, team, string_agg(result, '' ORDER BY n DESC) AS form FROM r WHERE n <= 5 GROUP BY season, grp, team"""


@query(_form(True))
def recent_form(spark, sf_dir):
    return stats.recent_form(fixtures(spark, sf_dir))


@query(_form(False))
def recent_form_by_day(spark, sf_dir):
    return stats.recent_form(fixtures(spark, sf_dir), by_round=False)


@query(
    f"""WITH {FIXTURES_SQL}, r AS (SELECT season, grp, team, {', '.join(f"CAST(count(*) FILTER (WHERE {c} AND result = '{r}') AS INT) {n}_{w}" for c, n in (('at_home', 'home'), ('NOT at_home', 'away')) for r, w in (('W', 'won'), ('D', 'drawn'), ('L', 'lost')))}
    FROM results WHERE result IS NOT NULL GROUP BY season, grp, team)
    SELECT *, {', '.join(f"CAST(CASE WHEN {n}_won + {n}_drawn + {n}_lost > 0 THEN floor(CAST({n}_won * 200 + {n}_won + {n}_drawn + {n}_lost AS DOUBLE) / (({n}_won + {n}_drawn + {n}_lost) * 2)) END AS INT) {n}_pct" for n in ('home', 'away'))} FROM r"""
)
def home_away_record(spark, sf_dir):
    return stats.home_away_record(fixtures(spark, sf_dir))


@query(f"WITH {FIXTURES_SQL} SELECT season, grp, team, floor(CAST(sum(gf) * 20 + count(*) AS DOUBLE) / (count(*) * 2)) / 10 avg_gf, floor(CAST(sum(ga) * 20 + count(*) AS DOUBLE) / (count(*) * 2)) / 10 avg_ga FROM results WHERE result IS NOT NULL GROUP BY season, grp, team")
def avg_goals(spark, sf_dir):
    return stats.average_goals(fixtures(spark, sf_dir))


def _extreme(direction: str) -> str:
    return f"""WITH {FIXTURES_SQL} SELECT season, grp, team, diff, gf, ga, opponent, match_date FROM (SELECT *, gf - ga diff, row_number() OVER (PARTITION BY season, grp, team ORDER BY gf - ga {direction}, {ORDER_SQL}) i
    FROM results WHERE result IS NOT NULL) WHERE i = 1"""


@query(_extreme("DESC"))
def biggest_win_team(spark, sf_dir):
    return stats.extreme_results(fixtures(spark, sf_dir), best=True)


@query(_extreme("ASC"))
def worst_loss_team(spark, sf_dir):
    return stats.extreme_results(fixtures(spark, sf_dir), best=False)


@query(
    f"""WITH {FIXTURES_SQL}, p AS (SELECT season, home_score + away_score g, grp <> 'ASIA' AND season <> 1997 AS lg FROM fixtures WHERE {PLAYED}),
    s AS (SELECT season, count(*) FILTER (WHERE lg) lm, sum(g) FILTER (WHERE lg) lgo, count(*) m, sum(g) g FROM p GROUP BY season)
    SELECT season, matches, CAST(goals AS BIGINT) goals, floor(CAST(goals * 200 + matches AS DOUBLE) / (matches * 2)) / 100 average
    FROM (SELECT season, CASE WHEN lm > 0 THEN lm ELSE m END matches, CASE WHEN lm > 0 THEN lgo ELSE g END goals FROM s)"""
)
def season_totals(spark, sf_dir):
    rows = fixtures(spark, sf_dir)
    return stats.season_totals(rows, rows.where("grp = 'ASIA' or season = 1997").select("season", "grp").distinct())


@query(
    f"""WITH {TABLE_SQL}, t AS (SELECT * FROM league WHERE played >= 10),
    m AS (SELECT season, team most_goals_team, gf most_goals FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY gf DESC, grp, position) i FROM t) WHERE i = 1),
    f AS (SELECT season, team least_conceded_team, ga least_conceded FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY ga, grp, position) i FROM t) WHERE i = 1)
    SELECT * FROM m JOIN f USING (season)"""
)
def season_extremes(spark, sf_dir):
    return stats.season_extremes(league(spark, sf_dir))


@query(f"WITH {TABLE_SQL} SELECT season, team, CAST(sum(gf) AS BIGINT) gf, CAST(sum(ga) AS BIGINT) ga FROM league GROUP BY season, team HAVING sum(gf) > 0 AND sum(ga) > 0")
def historical_team_goals(spark, sf_dir):
    return stats.historical_team_goals(league(spark, sf_dir))


def _top(by: str, second: str) -> str:
    return f"""WITH {FIXTURES_SQL} SELECT season, match_id, home, away, home_score, away_score, margin, total, CAST(i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY {by} DESC, {second} DESC, {ORDER_SQL}) i
    FROM (SELECT *, abs(home_score - away_score) margin, home_score + away_score total FROM fixtures WHERE {PLAYED})) WHERE i = 1"""


_TOP = ("season", "match_id", "home", "away", "home_score", "away_score", "margin", "total", "rank")


@query(_top("margin", "total"))
def biggest_win_season(spark, sf_dir):
    return stats.top_matches(fixtures(spark, sf_dir), "margin").select(*_TOP)


@query(_top("total", "margin"))
def highest_scoring_match(spark, sf_dir):
    return stats.top_matches(fixtures(spark, sf_dir), "total").select(*_TOP)


@query(
    f"""WITH {FIXTURES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY season, grp, team ORDER BY {ORDER_DESC}) n FROM results WHERE result IS NOT NULL),
    s AS (SELECT season, grp, team, coalesce(min(CASE WHEN result <> 'W' THEN n END), max(n) + 1) - 1 length FROM r GROUP BY season, grp, team)
    SELECT season, grp, team, CAST(length AS INT) length, CAST(i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY length DESC, team, grp) i FROM s WHERE length > 0) WHERE i <= 5"""
)
def top_win_streaks(spark, sf_dir):
    streaks = stats.current_streak(fixtures(spark, sf_dir)).where("streak = 'W'")
    return stats.top_by(streaks, 5, F.desc("length"), F.asc("team"), F.asc("grp")).select("season", "grp", "team", "length", "rank")


@query(
    f"""WITH {FIXTURES_SQL}, r AS (SELECT season, grp, team, count(*) n, count(*) FILTER (WHERE result = 'W') w FROM results WHERE result IS NOT NULL AND at_home GROUP BY season, grp, team HAVING count(*) >= 3),
    p AS (SELECT season, grp, team, CAST(floor(CAST(w * 200 + n AS DOUBLE) / (n * 2)) AS INT) home_pct FROM r)
    SELECT season, grp, team, home_pct, CAST(i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY home_pct DESC, team, grp) i FROM p) WHERE i <= 5"""
)
def top_home_records(spark, sf_dir):
    records = stats.home_away_record(fixtures(spark, sf_dir)).where("home_won + home_drawn + home_lost >= 3")
    return stats.top_by(records, 5, F.desc("home_pct"), F.asc("team"), F.asc("grp")).select("season", "grp", "team", "home_pct", "rank")


@query(
    f"""WITH {FIXTURES_SQL}, r AS (SELECT season, grp, team, count(*) n, count(*) FILTER (WHERE result = 'W') w FROM results WHERE result IS NOT NULL AND NOT at_home GROUP BY season, grp, team HAVING count(*) >= 3),
    p AS (SELECT season, grp, team, CAST(floor(CAST(w * 200 + n AS DOUBLE) / (n * 2)) AS INT) away_pct FROM r)
    SELECT season, grp, team, away_pct, CAST(i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY away_pct DESC, team, grp) i FROM p) WHERE i <= 5"""
)
def top_away_records(spark, sf_dir):
    records = stats.home_away_record(fixtures(spark, sf_dir)).where("away_won + away_drawn + away_lost >= 3")
    return stats.top_by(records, 5, F.desc("away_pct"), F.asc("team"), F.asc("grp")).select("season", "grp", "team", "away_pct", "rank")


@query(
    f"""WITH {FIXTURES_SQL}, a AS (SELECT season, grp, team, floor(CAST(sum(gf) * 20 + count(*) AS DOUBLE) / (count(*) * 2)) / 10 avg_gf FROM results WHERE result IS NOT NULL GROUP BY season, grp, team)
    SELECT season, grp, team, avg_gf, CAST(i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY avg_gf DESC, team, grp) i FROM a) WHERE i <= 5"""
)
def top_attacks(spark, sf_dir):
    return stats.top_by(stats.average_goals(fixtures(spark, sf_dir)), 5, F.desc("avg_gf"), F.asc("team"), F.asc("grp")).select("season", "grp", "team", "avg_gf", "rank")


@query(
    f"""WITH {FIXTURES_SQL}, p AS (SELECT least(home, away) team_a, greatest(home, away) team_b, CASE WHEN home < away THEN home_score ELSE away_score END x, CASE WHEN home < away THEN away_score ELSE home_score END y FROM fixtures WHERE {PLAYED})
    SELECT team_a, team_b, count(*) meetings, count(*) FILTER (WHERE x > y) wins_a, count(*) FILTER (WHERE x = y) draws, count(*) FILTER (WHERE x < y) wins_b, CAST(sum(x) AS BIGINT) goals_a, CAST(sum(y) AS BIGINT) goals_b FROM p GROUP BY team_a, team_b"""
)
def head_to_head(spark, sf_dir):
    return stats.head_to_head(fixtures(spark, sf_dir))


@query(
    f"""WITH {TABLE_SQL}, x AS (SELECT season, grp, a.team team_a, b.team team_b, a.points pa, b.points pb, a.won wa, b.won wb, a.gf fa, b.gf fb, a.ga ga, b.ga gb FROM league a JOIN league b USING (season, grp) WHERE a.position = 1 AND b.position = 2)
    SELECT season, grp, team_a, team_b, CASE WHEN pa = pb THEN '=' WHEN pa > pb THEN 'a' ELSE 'b' END better_points, CASE WHEN wa = wb THEN '=' WHEN wa > wb THEN 'a' ELSE 'b' END better_won,
    CASE WHEN fa = fb THEN '=' WHEN fa > fb THEN 'a' ELSE 'b' END better_gf, CASE WHEN ga = gb THEN '=' WHEN ga < gb THEN 'a' ELSE 'b' END better_ga FROM x"""
)
def compare_leaders(spark, sf_dir):
    computed = kept_league(spark, sf_dir)
    pairs = computed.groupBy("season", "grp").agg(F.max(F.when(F.col("position") == 1, F.col("team"))).alias("team_a"), F.max(F.when(F.col("position") == 2, F.col("team"))).alias("team_b"))
    return stats.compare_teams(computed, pairs)


@query(
    f"""WITH {TABLE_SQL}, f AS (SELECT season, grp, team focus, position AS own FROM league WHERE position = 4)
    SELECT season, grp, focus, l.position, l.team, l.points FROM f JOIN league l USING (season, grp) WHERE l.position BETWEEN own - 3 AND own + 3 OR l.position = 1"""
)
def rank_window(spark, sf_dir):
    computed = kept_league(spark, sf_dir)
    return stats.rank_window(computed, computed.where("position = 4").select("season", "grp", "team"))


@query(f"WITH {FIXTURES_SQL}, r AS (SELECT season, grp, round, count(home_score + away_score) n FROM fixtures GROUP BY ALL) SELECT season, grp, coalesce(max(round) FILTER (WHERE n > 0), min(round)) AS round FROM r GROUP BY season, grp")
def current_round(spark, sf_dir):
    return stats.current_round(fixtures(spark, sf_dir))


@query(
    f"""WITH {FIXTURES_SQL}, x AS (SELECT season, grp, min(match_date) FILTER (WHERE NOT ({PLAYED}) AND match_date >= DATE '{TODAY}') coming, max(match_date) FILTER (WHERE {PLAYED}) done FROM fixtures GROUP BY season, grp)
    SELECT season, grp, CASE WHEN coming IS NOT NULL THEN 'upcoming' WHEN done IS NOT NULL THEN 'finished' ELSE 'empty' END state, coalesce(coming, done) match_date FROM x"""
)
def season_outlook(spark, sf_dir):
    return stats.season_outlook(fixtures(spark, sf_dir), F.lit(TODAY).cast("date"))


@query(f"WITH {FIXTURES_SQL} SELECT season, grp, bool_and(({PLAYED}) OR match_date < DATE '{TODAY}') finished FROM fixtures GROUP BY season, grp")
def group_finished(spark, sf_dir):
    return stats.finished_groups(fixtures(spark, sf_dir), F.lit(TODAY).cast("date"))


@query(
    f"""WITH {FIXTURES_SQL} SELECT count(*) fixtures, count(*) FILTER (WHERE raw_home IS NULL AND raw_away IS NULL) unplayed, count(*) FILTER (WHERE (raw_home IS NULL) <> (raw_away IS NULL)) half,
    count(*) FILTER (WHERE (raw_home IS NOT NULL AND raw_home NOT BETWEEN 0 AND 50) OR (raw_away IS NOT NULL AND raw_away NOT BETWEEN 0 AND 50)) absurd,
    count(*) FILTER (WHERE raw_home BETWEEN 0 AND 50 AND raw_away BETWEEN 0 AND 50) sane FROM raw_fixtures"""
)
def score_sanity(spark, sf_dir):
    return scores.rejected_scores(raw_fixtures(spark, sf_dir), "raw_home", "raw_away")


@query(
    f"""WITH {FIXTURES_SQL} SELECT season, count(*) fixtures, count(*) FILTER (WHERE raw_home IS NOT NULL AND raw_away IS NOT NULL) played, count(*) FILTER (WHERE (raw_home IS NULL) <> (raw_away IS NULL)) half,
    count(*) FILTER (WHERE raw_home NOT BETWEEN 0 AND 50 OR raw_away NOT BETWEEN 0 AND 50) absurd FROM raw_fixtures GROUP BY season"""
)
def quality_report(spark, sf_dir):
    return gates.fill_report(raw_fixtures(spark, sf_dir))


@query(
    f"""WITH {FIXTURES_SQL}, r AS (SELECT season, count(*) fixtures, count(raw_home) played, count(*) FILTER (WHERE raw_home NOT BETWEEN 0 AND 50) absurd FROM raw_fixtures GROUP BY season),
    b AS (SELECT season, played + CASE season % 3 WHEN 0 THEN 5 WHEN 1 THEN -5 ELSE 0 END AS before FROM r)
    SELECT season, fixtures, played, absurd, played - before delta, CASE WHEN played - before < 0 THEN 'fewer' WHEN absurd * 10 > fixtures THEN 'suspect' ELSE 'ok' END verdict FROM r JOIN b USING (season)"""
)
def fill_verdict(spark, sf_dir):
    report = gates.fill_report(raw_fixtures(spark, sf_dir))
    shift = F.when(F.col("season") % 3 == 0, 5).when(F.col("season") % 3 == 1, -5).otherwise(0)
    return gates.fill_verdict(report, report.select("season", (F.col("played") + shift).alias("played")))


@query(
    f"""WITH {TABLE_SQL} SELECT season, grp, count(*) teams, count(*) FILTER (WHERE played <> won + drawn + lost OR abs(points - 3 * won - drawn) > 6) bad,
    count(*) FILTER (WHERE played <> won + drawn + lost OR abs(points - 3 * won - drawn) > 6) * 20 < count(*) passes FROM published GROUP BY season, grp"""
)
def standings_arithmetic(spark, sf_dir):
    return gates.arithmetic_share(published(spark, sf_dir))


@query(
    f"""WITH {FIXTURES_SQL} SELECT match_id, season, grp, home || '|' || away || '|' || coalesce(CAST(home_score AS VARCHAR), 'null') || '-' || coalesce(CAST(away_score AS VARCHAR), 'null') match_key FROM fixtures"""
)
def match_keys(spark, sf_dir):
    key = scores.match_key(*[F.col(c) for c in ("home", "away", "home_score", "away_score")])
    return fixtures(spark, sf_dir).select("match_id", "season", "grp", key.alias("match_key"))


@query(f"WITH {TABLE_SQL}, m AS (SELECT season, grp, max(gf) top FROM league GROUP BY season, grp) SELECT season, grp, team, CAST(greatest(3, least(100, floor(CAST(gf * 100 AS DOUBLE) / top + 0.5))) AS INT) bar FROM league JOIN m USING (season, grp)")
def goal_bars(spark, sf_dir):
    top = F.max("gf").over(Window.partitionBy("season", "grp"))
    return league(spark, sf_dir).select("season", "grp", "team", scores.bar_width(F.col("gf"), top).alias("bar"))


@query(f"WITH {FIXTURES_SQL} SELECT season, grp, team, count(*) n_matches, CAST(max(season) OVER (PARTITION BY team) AS INT) last_season FROM sides GROUP BY season, grp, team")
def team_last_season(spark, sf_dir):
    rows = standings.sides(fixtures(spark, sf_dir)).groupBy("season", "grp", "team").agg(F.count("*").alias("n_matches"))
    return rows.withColumn("last_season", F.max("season").over(Window.partitionBy("team")))
