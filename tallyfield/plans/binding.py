"""The competition tables as views of the star schema.

A line item is a fixture between the supplier's nation (home) and the customer's nation (away) of the same
region; ship year, region and ship month are season, group and round.  Scores come from quantity and part,
with the corrupt values a scraper leaves (-1, five digits) and with fixtures that were not played.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.scores import clean_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures as scraped: raw_home and raw_away may be absurd."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    hosts, guests = (F.broadcast(nations.select(F.col("n_nationkey").alias(f"{x}_key"), F.col("n_name").alias(x), F.col("r_name").alias(f"{x}_region"))) for x in ("home", "away"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(hosts, F.col("s_nationkey") == F.col("home_key")).select("s_suppkey", "home", "home_region")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(guests, F.col("c_nationkey") == F.col("away_key")).select("c_custkey", "away", "away_region")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "away", "away_region")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    quantity = F.col("l_quantity").cast("int")
    open_ = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A")
    home = F.when(open_, None).when(quantity == 50, 41000 + F.col("l_linenumber")).when(quantity == 49, -1).otherwise(quantity % 9)
    return joined.where("home_region = away_region and home <> away").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("match_id"),
        F.year("l_shipdate").cast("int").alias("season"),
        F.col("home_region").alias("grp"),
        F.month("l_shipdate").cast("int").alias("round"),
        F.col("l_shipdate").cast("date").alias("match_date"),
        "home",
        "away",
        home.cast("int").alias("raw_home"),
        F.when(~open_, (F.col("l_partkey") % 9).cast("int")).alias("raw_away"),
    )


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures with sane scores: see :data:`tallyfield.schema.FIXTURE`."""
    return clean_scores(raw_fixtures(spark, sf_dir), "raw_home", "raw_away")


def player_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, match_id (a day and a thousand of the users, so that a match stays small), team, player, kind, minute, side from the event log."""
    kinds = F.create_map(*[F.lit(x) for pair in (("purchase", "goal"), ("error", "red"), ("signup", "yellow"), ("view", "sub_out"), ("click", "sub_in")) for x in pair])
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        ((F.year(ts) * 1000 + F.dayofyear(ts)).cast("long") * 1_000_000 + F.floor(F.col("user_id") / 1000)).alias("match_id"),
        (F.col("user_id") % 20).cast("int").alias("team"),
        F.col("user_id").alias("player"),
        kinds[F.col("event_type")].alias("kind"),
        F.when(F.col("event_id") % 11 != 0, (F.hour(ts) * 60 + F.minute(ts)) % 90).cast("int").alias("minute"),
        F.when(F.col("user_id") % 2 == 0, "h").otherwise("a").alias("side"),
    )


def published_standings(computed: DataFrame) -> DataFrame:
    """A published table: the computed one with faults put in by rule.

    The first and third team of each group have wrong points (49 too few, 3 too few), the second has a
    match too few and every table of an odd season is one match behind.
    """
    pos, late = F.col("position"), F.col("season") % 2
    return computed.withColumns(
        {
            "points": (F.col("points") - F.when(pos == 1, 49).when(pos == 3, 3).otherwise(0)).cast("int"),
            "played": (F.col("played") - F.when(pos == 2, 1).otherwise(0) - late).cast("int"),
        }
    )


#: The same views for SQL engines, as common table expressions.
FIXTURES_SQL = """
raw_fixtures AS (
  SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS match_id, CAST(year(l.l_shipdate) AS INT) AS season, hr.r_name AS grp,
         CAST(month(l.l_shipdate) AS INT) AS round, CAST(l.l_shipdate AS DATE) AS match_date, hn.n_name AS home, an.n_name AS away,
         CAST(CASE WHEN l.l_linestatus = 'O' AND l.l_returnflag = 'A' THEN NULL WHEN CAST(l.l_quantity AS INT) = 50 THEN 41000 + l.l_linenumber
                   WHEN CAST(l.l_quantity AS INT) = 49 THEN -1 ELSE CAST(l.l_quantity AS INT) % 9 END AS INT) AS raw_home,
         CAST(CASE WHEN l.l_linestatus = 'O' AND l.l_returnflag = 'A' THEN NULL ELSE l.l_partkey % 9 END AS INT) AS raw_away
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation hn ON s.s_nationkey = hn.n_nationkey JOIN nation an ON c.c_nationkey = an.n_nationkey
  JOIN region hr ON hn.n_regionkey = hr.r_regionkey WHERE hn.n_regionkey = an.n_regionkey AND hn.n_name <> an.n_name),
fixtures AS (
  SELECT match_id, season, grp, round, match_date, home, away,
         CASE WHEN raw_home BETWEEN 0 AND 50 AND raw_away BETWEEN 0 AND 50 THEN raw_home END AS home_score,
         CASE WHEN raw_home BETWEEN 0 AND 50 AND raw_away BETWEEN 0 AND 50 THEN raw_away END AS away_score
  FROM raw_fixtures),
sides AS (
  SELECT match_id, season, grp, round, match_date, home, away, home_score, away_score, home AS team, away AS opponent, TRUE AS at_home, home_score AS gf, away_score AS ga FROM fixtures
  UNION ALL
  SELECT match_id, season, grp, round, match_date, home, away, home_score, away_score, away, home, FALSE, away_score, home_score FROM fixtures),
results AS (
  SELECT *, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' WHEN gf < ga THEN 'L' END AS result,
         CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 WHEN gf < ga THEN 0 END AS pts FROM sides)
"""

TABLE_SQL = (
    FIXTURES_SQL
    + """,
totals AS (
  SELECT season, grp, team, CAST(coalesce(sum(pts), 0) AS INT) AS points, CAST(count(result) AS INT) AS played, CAST(count(*) FILTER (WHERE result = 'W') AS INT) AS won,
         CAST(count(*) FILTER (WHERE result = 'D') AS INT) AS drawn, CAST(count(*) FILTER (WHERE result = 'L') AS INT) AS lost,
         CAST(coalesce(sum(gf), 0) AS INT) AS gf, CAST(coalesce(sum(ga), 0) AS INT) AS ga, CAST(coalesce(sum(gf - ga), 0) AS INT) AS gd
  FROM results GROUP BY season, grp, team),
league AS (SELECT season, grp, CAST(row_number() OVER (PARTITION BY season, grp ORDER BY points DESC, gd DESC, gf DESC, team) AS INT) AS position, team, points, played, won, drawn, lost, gf, ga, gd FROM totals),
published AS (
  SELECT season, grp, position, team, CAST(points - CASE position WHEN 1 THEN 49 WHEN 3 THEN 3 ELSE 0 END AS INT) AS points,
         CAST(played - CASE position WHEN 2 THEN 1 ELSE 0 END - season % 2 AS INT) AS played, won, drawn, lost, gf, ga, gd FROM league)
"""
)

EVENTS_SQL = """
player_events AS (
  SELECT event_id, CAST((year(ts) * 1000 + dayofyear(ts)) * 1000000::BIGINT + user_id // 1000 AS BIGINT) AS match_id, CAST(user_id % 20 AS INT) AS team, user_id AS player,
         CASE event_type WHEN 'purchase' THEN 'goal' WHEN 'error' THEN 'red' WHEN 'signup' THEN 'yellow' WHEN 'view' THEN 'sub_out' WHEN 'click' THEN 'sub_in' END AS kind,
         CAST(CASE WHEN event_id % 11 <> 0 THEN (hour(ts) * 60 + minute(ts)) % 90 END AS INT) AS minute, CASE WHEN user_id % 2 = 0 THEN 'h' ELSE 'a' END AS side
  FROM events)
"""
