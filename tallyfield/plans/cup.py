"""Queries on knock-out rounds, blocks and round order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions import text
from tallyfield.operators import cups, gates
from tallyfield.plans.binding import FIXTURES_SQL, fixtures, table
from tallyfield.plans.registry import query
from tallyfield.session import written

PLAYED = "home_score IS NOT NULL AND away_score IS NOT NULL"
_SEQ = """fr AS (SELECT season, grp, round, min((match_date, match_id)) first FROM fixtures GROUP BY season, grp, round),
    rs AS (SELECT season, grp, round, row_number() OVER (PARTITION BY season, grp ORDER BY first, round) round_seq FROM fr)"""
_CHAMPIONS = f"""lp AS (SELECT f.*, round_seq, max(round_seq) OVER (PARTITION BY season, grp) last FROM fixtures f JOIN rs USING (season, grp, round) WHERE {PLAYED}),
    ch AS (SELECT season, grp, any_value(CASE WHEN home_score > away_score THEN home WHEN home_score < away_score THEN away END) champion FROM lp WHERE round_seq = last GROUP BY season, grp
    HAVING count(*) = 1 AND any_value(CASE WHEN home_score > away_score THEN home WHEN home_score < away_score THEN away END) IS NOT NULL)"""
#: A bracket in each season and region: the n-th last fixture of a region's season is tie n; ties 1, 2-3, 4-7, ... are rounds.
_TIES = """tb AS (SELECT f.*, row_number() OVER (PARTITION BY season, grp ORDER BY match_date DESC, match_id DESC, home, away, home_score, away_score) back, count(*) OVER (PARTITION BY season, grp) ties FROM fixtures f),
    bracket AS (SELECT *, CAST(floor(log2(back)) AS INT) to_final, CAST(floor(log2(ties)) - floor(log2(back)) + 1 AS INT) round_seq FROM tb)"""


@query(
    f"""WITH {FIXTURES_SQL}, {_SEQ}, {_CHAMPIONS},
    t AS (SELECT season, grp, team, max(round_seq) deepest, count(*) FILTER (WHERE result = 'W') won, coalesce(sum(pts), 0) points, coalesce(sum(gf - ga), 0) gd FROM results JOIN rs USING (season, grp, round) GROUP BY season, grp, team)
    SELECT season, grp, CAST(row_number() OVER (PARTITION BY season, grp ORDER BY deepest DESC, coalesce(team = champion, FALSE) DESC, won DESC, points DESC, gd DESC, team) AS INT) AS position, team,
    CAST(deepest AS INT) deepest, coalesce(team = champion, FALSE) is_champion, CAST(won AS INT) won, CAST(points AS INT) points, CAST(gd AS INT) gd FROM t LEFT JOIN ch USING (season, grp)"""
)
def cup_ranking(spark, sf_dir):
    return cups.cup_ranking(written(fixtures(spark, sf_dir), "fixtures"))  # ranked in three passes, joined in one


@query(f"WITH {FIXTURES_SQL}, {_SEQ} SELECT season, grp, team, CAST(max(round_seq) AS INT) deepest FROM sides JOIN rs USING (season, grp, round) GROUP BY season, grp, team")
def deepest_round(spark, sf_dir):
    rows = cups.cup_rounds(fixtures(spark, sf_dir))
    return rows.select("season", "grp", F.explode(F.array("home", "away")).alias("team"), "round_seq").groupBy("season", "grp", "team").agg(F.max("round_seq").alias("deepest"))


def bracket(spark, sf_dir):
    """A region's season as a bracket: the last fixture is the final, the two before it are the round before, and so on back to the first."""
    group = Window.partitionBy("season", "grp")
    back = group.orderBy(F.desc("match_date"), F.desc("match_id"), "home", "away", "home_score", "away_score")
    depth = lambda n: F.floor(F.log2(n.cast("double"))).cast("int")
    rows = fixtures(spark, sf_dir).withColumns({"to_final": depth(F.row_number().over(back)), "first": depth(F.count("*").over(group))})
    return rows.withColumns({"round_seq": F.col("first") - F.col("to_final") + 1, "penalty_winner": F.when(F.col("match_id") % 3 == 0, F.col("away"))}).drop("first")


@query(
    f"""WITH {FIXTURES_SQL}, {_TIES}, b AS (SELECT *, CASE WHEN match_id % 3 = 0 THEN away END pw FROM bracket),
    seen AS (SELECT season, grp, team, max(round_seq) deepest FROM (SELECT season, grp, home team, round_seq FROM b UNION ALL SELECT season, grp, away, round_seq FROM b) GROUP BY season, grp, team)
    SELECT b.season, b.grp, b.round_seq, b.match_id, b.home, b.away, CASE WHEN home_score > away_score THEN b.home WHEN home_score < away_score THEN b.away
      WHEN home_score = away_score THEN coalesce(pw, CASE WHEN h.deepest > round_seq AND NOT a.deepest > round_seq THEN b.home WHEN a.deepest > round_seq AND NOT h.deepest > round_seq THEN b.away END) END advancer
    FROM b JOIN seen h ON b.season = h.season AND b.grp = h.grp AND b.home = h.team JOIN seen a ON b.season = a.season AND b.grp = a.grp AND b.away = a.team"""
)
def shootout_advancer(spark, sf_dir):
    return cups.advancers(bracket(spark, sf_dir)).select("season", "grp", "round_seq", "match_id", "home", "away", "advancer")


@query(f"""WITH {FIXTURES_SQL}, {_TIES} SELECT season, grp, CASE WHEN home_score > away_score THEN home WHEN home_score < away_score THEN away WHEN match_id % 3 = 0 THEN away END champion FROM bracket WHERE to_final = 0
    AND home_score IS NOT NULL AND (home_score <> away_score OR match_id % 3 = 0)""")
def bracket_champion(spark, sf_dir):
    return cups.bracket_champions(cups.advancers(bracket(spark, sf_dir)))


@query(f"WITH {FIXTURES_SQL}, {_SEQ}, n AS (SELECT season, grp, round_seq, count(*) c FROM fixtures JOIN rs USING (season, grp, round) GROUP BY ALL) SELECT season, grp, CASE WHEN count(*) = 1 THEN max_by(c, round_seq) > 2 ELSE max_by(c, round_seq) >= min_by(c, round_seq) END round_robin FROM n GROUP BY season, grp")
def round_robin_detector(spark, sf_dir):
    return cups.round_robin_cups(fixtures(spark, sf_dir))


_BLOCKS = "i AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders), g AS (SELECT o_custkey, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) x FROM i), bl AS (SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS size FROM g GROUP BY o_custkey, x)"


@query(f"WITH {_BLOCKS} SELECT * FROM bl")
def consecutive_blocks(spark, sf_dir):
    return cups.consecutive_blocks(table(spark, sf_dir, "orders"), "o_orderkey", ("o_custkey",))


@query(f"WITH {_BLOCKS}, s AS (SELECT o_custkey, string_agg(CAST(size AS VARCHAR), ',' ORDER BY first) sizes FROM bl GROUP BY o_custkey) SELECT o_custkey, sizes, sizes = '1,1,1,1' as_planned FROM s")
def block_structure(spark, sf_dir):
    found = cups.consecutive_blocks(table(spark, sf_dir, "orders"), "o_orderkey", ("o_custkey",))
    return gates.block_sizes(found, (1, 1, 1, 1), ("o_custkey",)).withColumn("sizes", F.concat_ws(",", F.col("sizes").cast("array<string>")))


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) back, count(*) OVER (PARTITION BY o_custkey) ties FROM orders)
    SELECT o_custkey, o_orderkey, CAST(CASE WHEN pow(2, floor(log2(back)) + 1) - 1 <= ties AND floor(log2(back)) <= 5 THEN floor(log2(back)) ELSE -1 END AS INT) to_final FROM o"""
)
def round_split(spark, sf_dir):
    return cups.split_rounds(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", ("o_custkey",))


@query("SELECT s_suppkey, chr(CAST(65 + (s_suppkey - 1 + 8) % 4 AS INT)) letter FROM supplier")
def round_robin_letter(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", cups.rotation_letter(F.col("s_suppkey"), 1, 4).alias("letter"))


_GROUPS = """g AS (SELECT c_custkey id, CASE c_custkey % 9 WHEN 0 THEN 'PCC' WHEN 1 THEN 'bca' WHEN 2 THEN 'MCP' WHEN 3 THEN 'MCBK' WHEN 4 THEN 'Xko' WHEN 5 THEN NULL ELSE 'PG' END || CASE WHEN c_custkey % 9 = 4 THEN '' ELSE c_custkey::VARCHAR END code,
    CASE c_custkey % 7 WHEN 0 THEN 'Copa de verano' WHEN 1 THEN 'Liga de Campeones' WHEN 2 THEN 'Maspalomas' WHEN 3 THEN NULL ELSE 'Primera Fase' END phase,
    CASE c_custkey % 5 WHEN 0 THEN ['( Ronda 1 )', 'ronda 2'] WHEN 1 THEN ['Ronda 1', '7'] WHEN 2 THEN []::VARCHAR[] ELSE ['1', '2'] END rounds FROM customer)"""


@query(
    f"""WITH {_GROUPS} SELECT id, NOT (coalesce(lower(phase), '') LIKE '%copa%' OR regexp_matches(coalesce(upper(code), ''), '^(PCC|BC)')) league,
    regexp_matches(coalesce(upper(code), ''), '^(PCC|BC|MCP|MCB)') OR regexp_matches(coalesce(lower(phase), ''), 'copa|campeon|maspalomas') cup,
    regexp_matches(coalesce(upper(code), ''), '^(PCC|BC|MCPK|MCBK)|KO$') OR regexp_matches(coalesce(lower(phase), ''), 'copa|campeon') OR (len(rounds) > 0 AND len(list_filter(rounds, lambda r: NOT lower(r) LIKE '%ronda%')) = 0) bracket FROM g"""
)
def cup_predicates(spark, sf_dir):
    """The three predicates over groups whose code, phase and rounds say different things."""
    k = F.col("c_custkey")
    prefix = F.when(k % 9 == 0, "PCC").when(k % 9 == 1, "bca").when(k % 9 == 2, "MCP").when(k % 9 == 3, "MCBK").when(k % 9 == 4, "Xko").when(k % 9 != 5, "PG")
    groups = table(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.concat(prefix, F.when(k % 9 == 4, "").otherwise(k.cast("string"))).alias("code"),
        F.when(k % 7 == 0, "Copa de verano").when(k % 7 == 1, "Liga de Campeones").when(k % 7 == 2, "Maspalomas").when(k % 7 != 3, "Primera Fase").alias("phase"),
        F.when(k % 5 == 0, F.array(F.lit("( Ronda 1 )"), F.lit("ronda 2"))).when(k % 5 == 1, F.array(F.lit("Ronda 1"), F.lit("7"))).when(k % 5 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("rounds"),
    )
    code, phase = F.col("code"), F.col("phase")
    return groups.select("id", cups.is_league_group(code, phase).alias("league"), cups.is_cup_group(code, phase).alias("cup"), cups.is_bracket_group(code, phase, F.col("rounds")).alias("bracket"))


_LABELS = "lb AS (SELECT DISTINCT o_custkey % 10 AS cup, CASE WHEN o_orderkey % 4 = 0 THEN 'final' WHEN o_orderkey % 4 = 1 THEN 'previa' ELSE 'Jornada ' || (o_orderkey % 40) END label, min(o_orderkey) OVER (PARTITION BY o_custkey % 10, CASE WHEN o_orderkey % 4 = 0 THEN 'final' WHEN o_orderkey % 4 = 1 THEN 'previa' ELSE 'Jornada ' || (o_orderkey % 40) END) seq FROM orders)"


@query(f"WITH {_LABELS} SELECT cup, label, CAST(row_number() OVER (PARTITION BY cup ORDER BY TRY_CAST(regexp_extract(label, '(\\d+)', 1) AS INT) NULLS LAST, seq) AS INT) n FROM lb")
def round_order(spark, sf_dir):
    """Numbered rounds in order of number, then the others in order of first appearance."""
    key = F.col("o_orderkey")
    label = F.when(key % 4 == 0, "final").when(key % 4 == 1, "previa").otherwise(F.concat(F.lit("Jornada "), (key % 40).cast("string")))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("cup"), label.alias("label"), key).groupBy("cup", "label").agg(F.min("o_orderkey").alias("seq"))
    order = Window.partitionBy("cup").orderBy(F.asc_nulls_last(text.round_number(F.col("label"))), "seq")
    return rows.select("cup", "label", F.row_number().over(order).cast("int").alias("n"))


# The legs of a round robin of four and the ties of a bracket of eight, as places of teams.
_LEGS = ((0, 1), (2, 3), (0, 2), (1, 3), (0, 3), (1, 2))
_BRACKET = ((0, 7), (1, 6), (2, 5), (3, 4), (0, 3), (1, 2), (0, 1))
_PAIRS = lambda pairs: "[" + ", ".join(f"[{a}, {b}]" for a, b in pairs) + "]"
_TOURNAMENT_SQL = f"""st AS (SELECT c_custkey t, c_custkey % 10 + n number, chr(CAST(65 + n % 4 AS INT)) l,
      CASE WHEN c_custkey % 9 = 2 AND n = 5 THEN 'X' ELSE chr(CAST(65 + n % 4 AS INT)) || CASE WHEN c_custkey % 9 = 3 AND n = 6 THEN 0 ELSE ({_PAIRS(_LEGS)})[n // 4 + 1][1] END END home,
      chr(CAST(65 + n % 4 AS INT)) || CASE WHEN c_custkey % 9 = 3 AND n = 6 THEN 1 ELSE ({_PAIRS(_LEGS)})[n // 4 + 1][2] END away,
      CASE WHEN (c_custkey + n) % 13 > 0 THEN (c_custkey * (n + 3) + n * n) % 5 + CASE WHEN n // 4 IN (0, 2, 3, 4) THEN 1 ELSE 0 END END hs, (c_custkey // 3 + n * 7) % 4 aws
    FROM customer, range(24) r(n) WHERE NOT (c_custkey % 9 = 1 AND n = 23)),
  ko AS (SELECT c_custkey t, b, c_custkey % 10 + 30 + 10 * b + n number, ({_PAIRS(_BRACKET)})[n + 1][1] h, ({_PAIRS(_BRACKET)})[n + 1][2] a, CASE WHEN c_custkey % 9 = 6 THEN 1 - b ELSE b END AS gold
    FROM customer, range(7) r(n), range(3) q(b) WHERE NOT (n > 0 AND b = 2) AND NOT (c_custkey % 9 = 4 AND b > 0) AND (b < 2 OR c_custkey % 9 = 5) AND c_custkey % 9 <> 7),
  kt AS (SELECT DISTINCT t, b, chr(CAST(65 + p % 4 AS INT)) || (p // 4 + CASE WHEN gold = 1 THEN 0 ELSE 2 END) team FROM (SELECT t, b, gold, unnest([h, a]) p FROM ko)),
  sd AS (SELECT t, l, home team, hs gf, aws ga FROM st WHERE hs IS NOT NULL UNION ALL SELECT t, l, away, aws, hs FROM st WHERE hs IS NOT NULL),
  tb AS (SELECT t, l, team, row_number() OVER (PARTITION BY t, l ORDER BY sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) DESC, sum(gf - ga) DESC, sum(gf) DESC, team) pos FROM sd GROUP BY t, l, team),
  sh AS (SELECT kt.t, kt.b, CAST(count(top.team) AS DOUBLE) / count(*) share FROM kt LEFT JOIN (SELECT DISTINCT t, team FROM tb WHERE pos <= 2) top ON kt.t = top.t AND kt.team = top.team GROUP BY kt.t, kt.b),
  ss AS (SELECT t, arg_max(b, share * 10 - b * 0.001) best, max(b) last, count(*) n FROM sh GROUP BY t),
  gr AS (SELECT t, l, count(*) n, count(DISTINCT least(home, away) || greatest(home, away)) pairs FROM st GROUP BY t, l),
  gt AS (SELECT t, l, count(DISTINCT team) teams FROM (SELECT t, l, home team FROM st UNION ALL SELECT t, l, away FROM st) GROUP BY t, l)"""


def tournaments(spark, sf_dir):
    """A tournament for each customer: four round robins of four, a lesser and a greater knock-out of eight; faults by rule."""
    k, n, fault = F.col("t"), F.col("n"), F.col("t") % 9
    at = lambda pairs, i, side: F.get(F.array(*[F.lit(p[side]) for p in pairs]), i.cast("int"))
    named = lambda letter, place: F.concat(F.chr(F.lit(65) + letter), place.cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("t"))
    stage = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(23)))).where(~((fault == 1) & (n == 23)))
    twice = (fault == 3) & (n == 6)
    leg = F.floor(n / 4)
    place = lambda side: F.when(twice, side).otherwise(at(_LEGS, leg, side))
    stage = stage.select(
        "t", (k % 10 + n).alias("number"), F.when((fault == 2) & (n == 5), "X").otherwise(named(n % 4, place(0))).alias("home"), named(n % 4, place(1)).alias("away"),
        F.when((k + n) % 13 > 0, (k * (n + 3) + n * n) % 5 + F.when(leg.isin(0, 2, 3, 4), 1).otherwise(0)).cast("int").alias("home_score"), ((F.floor(k / 3) + n * 7) % 4).cast("int").alias("away_score"),
    )
    b = F.col("b")
    ties = rows.withColumn("b", F.explode(F.when(fault == 7, F.array().cast("array<int>")).when(fault == 4, F.array(F.lit(0))).when(fault == 5, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))))
    ties = ties.withColumn("n", F.explode(F.sequence(F.lit(0), F.when(b == 2, 0).otherwise(6))))
    lower = F.when(F.when(fault == 6, 1 - b).otherwise(b) == 1, 0).otherwise(2)
    team = lambda side: named(at(_BRACKET, n, side) % 4, F.floor(at(_BRACKET, n, side) / 4) + lower)
    none = F.lit(None).cast("int")
    ties = ties.select("t", (k % 10 + 30 + 10 * b + n).alias("number"), team(0).alias("home"), team(1).alias("away"), none.alias("home_score"), none.alias("away_score"))
    return stage.unionByName(ties)


@query(
    f"""WITH {_TOURNAMENT_SQL}
    SELECT t, 'stage' fault, NULL::VARCHAR place, CAST(count(*) AS INT) AS found, 24 AS expected FROM st GROUP BY t HAVING count(*) <> 24
    UNION ALL SELECT t, 'matches', l, CAST(n AS INT), 6 FROM gr WHERE n <> 6 UNION ALL SELECT t, 'pairs', l, CAST(pairs AS INT), 6 FROM gr WHERE pairs <> 6
    UNION ALL SELECT t, 'teams', l, CAST(teams AS INT), 4 FROM gt WHERE teams <> 4
    UNION ALL SELECT t, 'cups', NULL, CAST(n AS INT), 2 FROM ss WHERE n <> 2
    UNION ALL SELECT t, 'seeding', NULL, CAST(best + 1 AS INT), CAST(last + 1 AS INT) FROM ss WHERE best <> last"""
)
def tournament_faults(spark, sf_dir):
    """Which rules of its shape each tournament breaks: sizes, round robins, number of knock-outs, seeding."""
    return cups.tournament_faults(tournaments(spark, sf_dir), 4, 4, 2, ("t",))
