"""Queries on joins, sets, merging, guards and publishing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions import dates, text
from tallyfield.operators import extract, gates, merge, publish, resolve, standings, stats
from tallyfield.plans.binding import EVENTS_SQL, FIXTURES_SQL, TABLE_SQL, fixtures, player_events, published_standings, table
from tallyfield.plans.league import league
from tallyfield.plans.registry import query
from tallyfield.session import scratch_path
from tallyfield.sources import landed

PLAYED = "home_score IS NOT NULL AND away_score IS NOT NULL"


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphans(spark, sf_dir):
    return gates.orphans(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return gates.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, s_nation home, c_nation away FROM (SELECT o_orderkey, c_nationkey c_nation, o_orderkey % 25 s_nation FROM orders JOIN customer ON o_custkey = c_custkey) WHERE s_nation = c_nation")
def self_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return gates.self_matches(rows.select("o_orderkey", (F.col("o_orderkey") % 25).alias("home"), F.col("c_nationkey").alias("away")))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def domain_violations(spark, sf_dir):
    return gates.outside(table(spark, sf_dir, "orders"), "o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM")).select("o_orderkey", "o_orderpriority")


@query(f"WITH {FIXTURES_SQL} SELECT season, team, count(*) n FROM fixtures, (SELECT n_name team FROM nation) t WHERE t.team = home OR t.team = away GROUP BY season, team")
def or_membership(spark, sf_dir):
    """A match belongs to both of its teams: exploded to two rows, so that the join has a key."""
    rows = fixtures(spark, sf_dir).select("season", F.explode(F.array("home", "away")).alias("team"))
    return rows.join(table(spark, sf_dir, "nation").select(F.col("n_name").alias("team")), "team").groupBy("season", "team").agg(F.count("*").alias("n"))


@query(f"WITH {FIXTURES_SQL}, g AS (SELECT DISTINCT season, grp FROM fixtures) SELECT g.season, g.grp, count(f.match_id) n, count(f.match_id) FILTER (WHERE {PLAYED}) played FROM g LEFT JOIN fixtures f ON g.season = f.season AND g.grp = f.grp AND f.round > 11 GROUP BY g.season, g.grp")
def left_join_counts(spark, sf_dir):
    rows = fixtures(spark, sf_dir)
    late = rows.where("round > 11").select("season", "grp", "match_id", "home_score", "away_score")
    joined = rows.select("season", "grp").distinct().join(late, ["season", "grp"], "left")
    return joined.groupBy("season", "grp").agg(F.count("match_id").alias("n"), F.count_if(F.expr(PLAYED)).alias("played"))


@query("WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) SELECT a.l_orderkey, a.l_linenumber, a.l_partkey keeps, b.l_partkey goes FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey < b.l_partkey WHERE a.l_partkey = (SELECT min(l_partkey) FROM l c WHERE c.l_orderkey = a.l_orderkey AND c.l_linenumber = a.l_linenumber)")
def duplicate_rows_by_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    low = F.min("l_partkey").over(Window.partitionBy("l_orderkey", "l_linenumber"))
    return rows.withColumn("keeps", low).where("l_partkey > keeps").select("l_orderkey", "l_linenumber", "keeps", F.col("l_partkey").alias("goes"))


@query(f"WITH {FIXTURES_SQL}, k AS (SELECT match_id, season, grp, match_date, home || '|' || away || '|' || home_score || '-' || away_score mk FROM fixtures WHERE {PLAYED}), t AS (SELECT mk, min(match_date) first_day, count(*) n FROM k GROUP BY mk) SELECT k.season, k.grp, count(*) FILTER (WHERE n > 1) ambiguous, count(*) matched FROM k JOIN t USING (mk) GROUP BY k.season, k.grp")
def match_key_lookup(spark, sf_dir):
    """Looking matches up by teams and score: the key repeats, so ambiguity is counted, not hidden."""
    rows = fixtures(spark, sf_dir).where(PLAYED).withColumn("mk", F.concat("home", F.lit("|"), "away", F.lit("|"), F.col("home_score").cast("string"), F.lit("-"), F.col("away_score").cast("string")))
    keys = rows.groupBy("mk").agg(F.count("*").alias("n"))
    return rows.join(keys, "mk").groupBy("season", "grp").agg(F.count_if(F.col("n") > 1).alias("ambiguous"), F.count("*").alias("matched"))


@query(f"WITH {FIXTURES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY home, away, home_score, away_score ORDER BY match_date, match_id) i FROM fixtures WHERE {PLAYED}) SELECT home, away, home_score, away_score, match_id, match_date FROM b WHERE i = 1")
def score_keyed_lookup(spark, sf_dir):
    order = Window.partitionBy("home", "away", "home_score", "away_score").orderBy("match_date", "match_id")
    return fixtures(spark, sf_dir).where(PLAYED).withColumn("i", F.row_number().over(order)).where("i = 1").select("home", "away", "home_score", "away_score", "match_id", "match_date")


@query(f"WITH {TABLE_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY grp) i FROM league) SELECT team, season, grp, position, points FROM s WHERE i = 1")
def points_per_season_cross(spark, sf_dir):
    first = Window.partitionBy("season", "team").orderBy("grp")
    return league(spark, sf_dir).withColumn("i", F.row_number().over(first)).where("i = 1").select("team", "season", "grp", "position", "points")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def missing_badges(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(rich, "n_nationkey", "left_anti").select("n_name", "n_regionkey")


@query(f"WITH {FIXTURES_SQL}, v AS (SELECT home, away, min(match_date) first_day FROM fixtures GROUP BY home, away) SELECT f.match_id, f.season, f.home, f.away, v.first_day FROM fixtures f LEFT JOIN v ON f.home = v.home AND f.away = v.away")
def venue_enrichment(spark, sf_dir):
    rows = fixtures(spark, sf_dir)
    known = rows.groupBy("home", "away").agg(F.min("match_date").alias("first_day"))
    return rows.join(known, ["home", "away"], "left").select("match_id", "season", "home", "away", "first_day")


_SCHEDULES = """i AS (SELECT DISTINCT c_nationkey c, strftime(o_orderdate, '%Y%m%d') || o_orderpriority AS k FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT c, count(*) n FROM i GROUP BY c),
    ov AS (SELECT a.c set_id, b.c other_id, count(*) shared, any_value(x.n) n, any_value(y.n) other_n, count(*) / least(any_value(x.n), any_value(y.n)) overlap FROM i a JOIN i b ON a.k = b.k AND a.c < b.c JOIN s x ON a.c = x.c JOIN s y ON b.c = y.c GROUP BY a.c, b.c)"""


def _schedules(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(F.col("c_nationkey").alias("set_id"), F.concat(F.date_format("o_orderdate", "yyyyMMdd"), "o_orderpriority").alias("item"))


@query(f"WITH {_SCHEDULES} SELECT set_id, other_id, shared, overlap FROM ov WHERE overlap >= 0.03")
def schedule_overlap(spark, sf_dir):
    return resolve.set_overlap(_schedules(spark, sf_dir), least=0.03).select("set_id", "other_id", "shared", "overlap")


@query(f"WITH {_SCHEDULES} SELECT CASE WHEN n >= other_n THEN set_id ELSE other_id END AS stays, CASE WHEN n >= other_n THEN other_id ELSE set_id END AS goes, overlap FROM ov WHERE overlap >= 0.05 AND n >= 10 AND other_n >= 10")
def duplicate_groups(spark, sf_dir):
    items = _schedules(spark, sf_dir)
    played = items.distinct().groupBy("set_id").agg(F.count("*").alias("played"))
    return resolve.duplicate_groups(items, played, least=0.05)


@query("WITH t AS (SELECT DISTINCT c_mktsegment grp, c_nationkey team FROM customer WHERE c_acctbal > 9500), c AS (SELECT DISTINCT c_mktsegment grp, c_nationkey team FROM customer WHERE c_acctbal < -500) SELECT grp, team, 'table' only_in FROM (SELECT * FROM t EXCEPT SELECT * FROM c) UNION ALL SELECT grp, team, 'calendar' FROM (SELECT * FROM c EXCEPT SELECT * FROM t)")
def table_vs_calendar(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("team"), "c_custkey", "c_acctbal")
    return gates.only_in_one(rows.where("c_acctbal > 9500"), rows.where("c_acctbal < -500"), ("grp",))


@query("SELECT 'customer' kind, c_nationkey n, c_name name FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_name FROM supplier")
def source_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("n"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("n"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"WITH {FIXTURES_SQL} SELECT grp, round, count(DISTINCT season) seasons, count(*) n FROM fixtures GROUP BY grp, round")
def facet_counts(spark, sf_dir):
    return fixtures(spark, sf_dir).groupBy("grp", "round").agg(F.countDistinct("season").alias("seasons"), F.count("*").alias("n"))


@query(f"WITH {FIXTURES_SQL} SELECT season, grp, count(DISTINCT team) hits FROM sides WHERE lower(team) LIKE '%1%' GROUP BY season, grp")
def team_search(spark, sf_dir):
    rows = fixtures(spark, sf_dir).select("season", "grp", F.explode(F.array("home", "away")).alias("team")).where(F.lower("team").contains("1"))
    return rows.groupBy("season", "grp").agg(F.countDistinct("team").alias("hits"))


_STORED = f"""{FIXTURES_SQL}, base AS (SELECT match_id, season, grp, round, home, away, max(home_score) home_score, max(away_score) away_score FROM fixtures GROUP BY match_id, season, grp, round, home, away),
    f AS (SELECT season, grp, round, home, away, max_by(match_id, match_id) match_id FROM base GROUP BY season, grp, round, home, away),
    one AS (SELECT base.* FROM base JOIN f USING (season, grp, round, home, away, match_id))"""


def _one_per_key(spark, sf_dir):
    """The largest scores of each match, and of each key the match with the largest id."""
    keys = ["season", "grp", "round", "home", "away"]
    single = fixtures(spark, sf_dir).groupBy("match_id", *keys).agg(F.max("home_score").alias("home_score"), F.max("away_score").alias("away_score"))
    return merge.last_wins(single, keys, "match_id"), keys


@query(
    f"""WITH {_STORED}, stored AS (SELECT season, grp, round, home, away, CASE WHEN round <= 6 THEN home_score END hs, CASE WHEN round <= 6 THEN away_score END ays FROM one WHERE round <= 9),
    inc AS (SELECT season, grp, round, home, away, home_score, away_score FROM one)
    SELECT season, grp, round, home, away, CASE WHEN s.season IS NULL OR (hs IS NULL AND ays IS NULL) THEN inc.home_score ELSE hs END home_score, CASE WHEN s.season IS NULL OR (hs IS NULL AND ays IS NULL) THEN inc.away_score ELSE ays END away_score
    FROM inc LEFT JOIN stored s USING (season, grp, round, home, away)"""
)
def upsert_fill_nulls(spark, sf_dir):
    rows, keys = _one_per_key(spark, sf_dir)
    seen = F.col("round") <= 6  # an earlier load: fixtures up to round 9, scores up to round 6
    stored = rows.where("round <= 9").withColumns({c: F.when(seen, F.col(c)) for c in ("home_score", "away_score")})
    return merge.fill_nulls(stored.select(*keys, "home_score", "away_score"), rows.select(*keys, "home_score", "away_score"), keys, ["home_score", "away_score"])


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) i FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE i = 1")
def replace_last_wins(spark, sf_dir):
    return merge.last_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) i FROM orders) SELECT o_custkey, o_orderkey, CAST(i AS INT) claim FROM r WHERE i > 1")
def second_claims(spark, sf_dir):
    return merge.first_claim(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"])[1].select("o_custkey", "o_orderkey", "claim")


@query(
    f"""WITH {FIXTURES_SQL}, s AS (SELECT season, grp, count(*) FILTER (WHERE {PLAYED} ) n FROM fixtures WHERE season < 2001 AND round <= 6 GROUP BY season, grp),
    i AS (SELECT season, grp, count(*) FILTER (WHERE {PLAYED}) n FROM fixtures WHERE season > 1995 AND (season % 2 = 0 OR round <= 3) GROUP BY season, grp)
    SELECT season, grp, coalesce(s.n, 0) AS stored, coalesce(i.n, 0) AS incoming, CASE WHEN i.n IS NOT NULL AND (s.n IS NULL OR i.n > s.n) THEN 'replace' ELSE 'keep' END AS action FROM s FULL JOIN i USING (season, grp)"""
)
def no_regression_pick(spark, sf_dir):
    rows = fixtures(spark, sf_dir)
    return merge.no_regression(rows.where("season < 2001 and round <= 6"), rows.where("season > 1995 and (season % 2 = 0 or round <= 3)"), ["season", "grp"])


@query(
    f"""WITH {TABLE_SQL}, st AS (SELECT season, grp, max(played) sp, count(DISTINCT team) stt FROM league GROUP BY season, grp),
    inc AS (SELECT season, grp, team, CASE WHEN season = 1996 THEN 2 ELSE played - season % 3 END played FROM league WHERE season <> 1998 AND (season <> 1999 OR position > 3)),
    ic AS (SELECT season, grp, max(played) ip, count(DISTINCT team) it FROM inc GROUP BY season, grp)
    SELECT season, grp, sp stored_played, ip incoming_played, CASE WHEN it IS NULL THEN 'empty' WHEN sp >= 5 AND ip <= 2 THEN 'restarted' WHEN ip < sp THEN 'fewer played' WHEN it * 2 < stt THEN 'other teams' END reason FROM st LEFT JOIN ic USING (season, grp)"""
)
def replacement_guard(spark, sf_dir):
    stored = league(spark, sf_dir)
    return gates.replacement_guard(stored, _reloaded(stored), ["season", "grp"])


def _reloaded(stored):
    return stored.where("season <> 1998 and (season <> 1999 or position > 3)").withColumn("played", F.when(F.col("season") == 1996, 2).otherwise(F.col("played") - F.col("season") % 3))


@query(
    f"""WITH {TABLE_SQL}, st AS (SELECT season, grp, max(played) sp, count(DISTINCT team) stt FROM league GROUP BY season, grp),
    inc AS (SELECT season, grp, team, CASE WHEN season = 1996 THEN 2 ELSE played - season % 3 END played FROM league WHERE season <> 1998 AND (season <> 1999 OR position > 3)),
    ic AS (SELECT season, grp, max(played) ip, count(DISTINCT team) it FROM inc GROUP BY season, grp),
    r AS (SELECT (it IS NULL OR (sp >= 5 AND ip <= 2) OR ip < sp OR it * 2 < stt) bad FROM st LEFT JOIN ic USING (season, grp))
    SELECT count(*) n_groups, count(*) FILTER (WHERE bad) skipped, count(*) FILTER (WHERE bad) = count(*) OR (count(*) FILTER (WHERE bad) >= 3 AND count(*) FILTER (WHERE bad) >= 0.25 * count(*)) AS abort FROM r"""
)
def rollover_abort(spark, sf_dir):
    stored = league(spark, sf_dir)
    return gates.rollover_abort(gates.replacement_guard(stored, _reloaded(stored), ["season", "grp"]))


@query("SELECT o.o_orderkey, CASE WHEN c.c_custkey IS NULL AND o.o_orderdate >= TIMESTAMP '1997-01-01' THEN NULL ELSE o.o_custkey END o_custkey FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey")
def orphan_clearing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    parents = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return merge.without_orphans(orders, parents, "o_custkey", orders.where("y >= 1997").select("y").distinct(), "y").select("o_orderkey", "o_custkey")


@query("WITH a AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) k FROM customer), r AS (SELECT k, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY k, o_orderpriority ORDER BY o_orderkey) i FROM orders JOIN a ON o_custkey = c_custkey) SELECT k AS o_custkey, o_orderpriority, o_orderkey FROM r WHERE i = 1")
def entity_merge(spark, sf_dir):
    w = Window.partitionBy("c_nationkey", "c_mktsegment")
    aliases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.min("c_custkey").over(w).alias("canonical_id"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return merge.repointed(orders, aliases, ["o_custkey"], ["o_custkey", "o_orderpriority"], ["o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("WITH s AS (SELECT s_nationkey n, s_name name, s_acctbal bal FROM supplier), st AS (SELECT n, max(name) name, min(bal) bal FROM s GROUP BY n), i AS (SELECT c_nationkey n, max(CASE WHEN c_acctbal > 9000 THEN c_name END) name, max(c_acctbal) bal FROM customer GROUP BY c_nationkey) SELECT n, coalesce(i.name, st.name) AS name, coalesce(i.bal, st.bal) bal FROM st FULL JOIN i USING (n)")
def upsert_dimension(spark, sf_dir):
    stored = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.max("s_name").alias("name"), F.min("s_acctbal").alias("bal"))
    rich = F.when(F.col("c_acctbal") > 9000, F.col("c_name"))
    incoming = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), rich.alias("name"), F.col("c_acctbal").alias("bal"))
    return merge.upsert_dimension(stored, incoming, ["n"], ["name", "bal"])


@query("SELECT c FROM (SELECT CAST(p_retailprice AS VARCHAR) c FROM part GROUP BY 1 HAVING count(*) > 1 UNION SELECT CAST(p_retailprice AS VARCHAR) FROM part WHERE p_retailprice IN (SELECT c_acctbal FROM customer))")
def code_collisions(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("c"))
    return merge.collisions(codes, "c", table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("c"))).select(F.col("c").cast("string").alias("c"))


@query("WITH c AS (SELECT o_custkey k, o_orderkey id, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END strategy_rank FROM orders), b AS (SELECT k, min(strategy_rank) strategy_rank FROM c GROUP BY k) SELECT DISTINCT k, strategy_rank, id FROM c JOIN b USING (k, strategy_rank)")
def strategy_cascade(spark, sf_dir):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    return merge.by_strategy(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), rank.alias("strategy_rank")), "k")


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def pending_pages(spark, sf_dir):
    return merge.pending(table(spark, sf_dir, "pages").select("page_id"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")), "page_id")


@query(
    "WITH ix AS (SELECT o_custkey slug, strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') ts, o_orderpriority digest, CASE WHEN o_orderstatus = 'F' THEN 200 ELSE 404 END status FROM orders), g AS (SELECT slug, digest, min(ts) ts FROM ix WHERE status = 200 AND ts BETWEEN '1996' AND '1999' GROUP BY slug, digest), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ts DESC, digest DESC) i FROM g) SELECT slug, ts AS \"timestamp\", digest FROM r WHERE i = 1"
)
def latest_snapshot(spark, sf_dir):
    ts = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    index = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug"), ts.alias("timestamp"), F.col("o_orderpriority").alias("digest"), F.when(F.col("o_orderstatus") == "F", 200).otherwise(404).alias("status"))
    return landed.newest_snapshots(index, "1996", "1999")


@query()
def change_digest(spark, sf_dir):
    """A digest per season: the hash function is the engine's own, so there is no SQL to compare with."""
    return league(spark, sf_dir).groupBy("season").agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64("grp", "position", "team", "points", "gf", "ga")).alias("digest"))


@query(f"WITH {TABLE_SQL} SELECT season, grp, string_agg(position || ':' || team || ':' || points, ',' ORDER BY position) AS standings FROM league GROUP BY season, grp")
def standings_arrays(spark, sf_dir):
    nested = publish.standings_arrays(league(spark, sf_dir))
    text = F.transform("standings", lambda s: F.concat_ws(":", s["pos"].cast("string"), s["team"], s["pts"].cast("string")))
    return nested.select("season", "grp", F.concat_ws(",", text).alias("standings"))


@query()
def json_publish(spark, sf_dir):
    rows = fixtures(spark, sf_dir)
    return publish.category_documents(standings.league_table(rows), rows)


@query()
def season_statistics(spark, sf_dir):
    rows = fixtures(spark, sf_dir)
    return publish.season_statistics(stats.current_streak(rows), stats.home_away_record(rows), stats.average_goals(rows), stats.points_curve(rows))


@query(
    f"""WITH {FIXTURES_SQL} SELECT season, grp, team, count(*) FILTER (WHERE at_home AND result = 'W') home_won, count(*) FILTER (WHERE NOT at_home AND result = 'L') away_lost, (20 * sum(gf) FILTER (WHERE result IS NOT NULL) + count(result)) // (2 * count(result)) / 10 avg_gf
    FROM results WHERE season = 1996 GROUP BY season, grp, team"""
)
def published_season(spark, sf_dir):
    """Statistics of the teams of one season, from the files that all seasons are published in."""
    path = scratch_path(spark, "seasons")
    publish.write_seasons(season_statistics(spark, sf_dir), path)
    schema = "array<struct<grp:string,team:string,home:struct<home_won:long>,away:struct<away_lost:long>,avg_gf:double>>"
    held = spark.read.schema("document string, season int").json(path).where("season = 1996")
    teams = held.select("season", F.explode(F.from_json("document", schema)).alias("t"))
    return teams.select("season", "t.grp", "t.team", "t.home.home_won", "t.away.away_lost", "t.avg_gf")


@query(
    f"""WITH {TABLE_SQL}, p AS (SELECT season, grp, count(*) n FROM league WHERE NOT (season = 1999 AND position = 5) GROUP BY season, grp), s AS (SELECT season, grp, count(*) n FROM league GROUP BY season, grp)
    SELECT season, grp, s.n n_stored, p.n n_published FROM s FULL JOIN p USING (season, grp) WHERE s.n IS DISTINCT FROM p.n"""
)
def published_count_gap(spark, sf_dir):
    stored = league(spark, sf_dir)
    return gates.count_gap(stored, stored.where("not (season = 1999 and position = 5)"), ("season", "grp"))


@query(f"WITH {EVENTS_SQL}, l AS (SELECT match_id, player, min(side) side FROM player_events WHERE kind = 'sub_in' GROUP BY match_id, player) SELECT e.event_id, l.side known_side FROM player_events e JOIN l USING (match_id, player) WHERE e.kind = 'goal'")
def events_with_known_side(spark, sf_dir):
    rows = player_events(spark, sf_dir)
    lineup = rows.where("kind = 'sub_in'").select("match_id", F.col("player").alias("name"), "side")
    return extract.sided_events(rows.where("kind = 'goal'").select("event_id", "match_id", "player"), lineup).select("event_id", F.col("side").alias("known_side"))


@query(f"WITH {FIXTURES_SQL}, k AS (SELECT season, home, away, match_date, count(*) n, min(match_id) first_id FROM fixtures GROUP BY ALL) SELECT DISTINCT f.match_id, f.season, f.home, f.away FROM fixtures f JOIN k USING (season, home, away, match_date) WHERE f.match_id > first_id")
def doomed_duplicates(spark, sf_dir):
    """Fixtures for which an earlier row of the same teams and day exists."""
    rows = fixtures(spark, sf_dir)
    key = ["season", "home", "away", "match_date"]
    first = rows.groupBy(*key).agg(F.min("match_id").alias("first_id"))
    return rows.join(first, key).where("match_id > first_id").select("match_id", "season", "home", "away").distinct()


@query(f"WITH {TABLE_SQL} SELECT DISTINCT f.match_id, f.season, f.home, f.away, CASE WHEN w.team IS NULL AND v.team IS NULL THEN home_score END home_score, CASE WHEN w.team IS NULL AND v.team IS NULL THEN away_score END away_score FROM fixtures f LEFT JOIN (SELECT season, grp, team FROM league WHERE position = 5) w ON f.season = w.season AND f.grp = w.grp AND f.home = w.team LEFT JOIN (SELECT season, grp, team FROM league WHERE position = 5) v ON f.season = v.season AND f.grp = v.grp AND f.away = v.team")
def withdrawn_scores(spark, sf_dir):
    """Teams in the schedule but not in the table (here: its first four) have withdrawn; their fixtures lose their scores."""
    rows = fixtures(spark, sf_dir)
    listed = league(spark, sf_dir).where("position <> 5")
    schedule = rows.select("season", "grp", F.explode(F.array("home", "away")).alias("team"))
    gone = resolve.withdrawn(schedule, listed, ("season", "grp"))
    return resolve.without_withdrawn_scores(rows, gone, ("season", "grp")).select("match_id", "season", "home", "away", "home_score", "away_score").distinct()


@query(f"WITH {TABLE_SQL}, x AS (SELECT season, grp, team, count(*) FILTER (WHERE at_home AND result IS NOT NULL) hp, count(*) FILTER (WHERE NOT at_home AND result IS NOT NULL) ap FROM results GROUP BY season, grp, team) SELECT season, grp, team, CAST(hp + ap AS INT) played FROM x")
def split_totals(spark, sf_dir):
    """Tables that give home and away parts, summed."""
    rows = standings.sides(fixtures(spark, sf_dir))  # teams without a result keep a row of zeros
    parts = {}
    for side, at_home in (("home", True), ("away", False)):
        own = F.col("at_home") == at_home
        parts |= {f"{side}_played": F.count_if(own & F.col("result").isNotNull()), **{f"{side}_{c}": F.count_if(own & (F.col("result") == r)) for c, r in (("won", "W"), ("drawn", "D"), ("lost", "L"))}, **{f"{side}_{c}": F.sum(F.when(own, F.col(c))) for c in ("gf", "ga")}}
    wide = rows.groupBy("season", "grp", "team").agg(*[c.alias(n) for n, c in parts.items()])
    return standings.split_totals(wide).select("season", "grp", "team", "played")


@query(f"WITH {FIXTURES_SQL} SELECT season, count(DISTINCT grp) n_groups, count(DISTINCT team) n_teams, count(DISTINCT (match_id, home, away)) n_matches FROM sides GROUP BY season")
def source_counters(spark, sf_dir):
    rows = standings.sides(fixtures(spark, sf_dir))
    return rows.groupBy("season").agg(F.countDistinct("grp").alias("n_groups"), F.countDistinct("team").alias("n_teams"), F.countDistinct("match_id", "home", "away").alias("n_matches"))


@query(f"WITH {FIXTURES_SQL} SELECT DISTINCT season, grp, team FROM sides")
def distinct_teams(spark, sf_dir):
    return fixtures(spark, sf_dir).select("season", "grp", F.explode(F.array("home", "away")).alias("team")).distinct()


@query(f"WITH {FIXTURES_SQL} SELECT season, grp, max(round) FILTER (WHERE home_score IS NOT NULL) last_round FROM fixtures GROUP BY season, grp")
def last_round_with_result(spark, sf_dir):
    rounds = stats.round_states(fixtures(spark, sf_dir))
    return rounds.groupBy("season", "grp").agg(F.max(F.when(F.col("results") > 0, F.col("round"))).alias("last_round"))


@query("WITH s AS (SELECT DISTINCT year(o_orderdate) season FROM orders) SELECT season, CAST(row_number() OVER (ORDER BY season DESC) AS INT) n FROM s")
def seasons_newest_first(spark, sf_dir):
    seasons = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season")).distinct()
    return seasons.withColumn("n", F.row_number().over(Window.orderBy(F.desc("season"))).cast("int"))


@query("SELECT p_brand, CAST(row_number() OVER (ORDER BY TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INT) NULLS LAST, p_brand) AS INT) n FROM (SELECT DISTINCT p_brand FROM part)")
def group_order(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    number = F.regexp_replace("p_brand", "[^0-9]", "").try_cast("int")
    return brands.withColumn("n", F.row_number().over(Window.orderBy(F.asc_nulls_last(number), "p_brand")).cast("int"))


@query(
    f"""WITH {FIXTURES_SQL}, f AS (SELECT season, grp, match_id, CASE WHEN match_id % 13 = 0 THEN '' WHEN match_id % 17 = 0 THEN away WHEN match_id % 19 = 0 THEN NULL ELSE home END home, away, home_score, away_score FROM fixtures)
    SELECT season, grp, count(*) n, sum(home_score) goals FROM f WHERE home IS NOT NULL AND home NOT IN ('', away) AND home_score + away_score >= 0 GROUP BY season, grp"""
)
def finished_fixtures(spark, sf_dir):
    """Fixtures of finished seasons, without those that have no score, no team or one team twice."""
    k = F.col("match_id")
    rows = fixtures(spark, sf_dir).withColumn("home", F.when(k % 13 == 0, "").when(k % 17 == 0, F.col("away")).when(k % 19 != 0, F.col("home")))
    return gates.finished_fixtures(rows).groupBy("season", "grp").agg(F.count("*").alias("n"), F.sum("home_score").alias("goals"))


@query(
    """WITH g AS (SELECT c_custkey grp FROM customer), h AS (SELECT o_custkey grp, count(*) n FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey), l AS (SELECT o_custkey grp, count(*) n FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 2 = 0 GROUP BY o_custkey),
    r AS (SELECT o_custkey grp, count(*) n FROM orders WHERE o_orderkey % 5 < 2 GROUP BY o_custkey)
    SELECT g.grp, CASE WHEN h.n > 0 THEN 'history' WHEN l.n > 0 THEN 'list' WHEN r.n > 0 THEN 'rounds' END source, coalesce(h.n, l.n, r.n, 0) matches FROM g LEFT JOIN h ON g.grp = h.grp LEFT JOIN l ON g.grp = l.grp LEFT JOIN r ON g.grp = r.grp"""
)
def match_counts(spark, sf_dir):
    """Matches of groups by their history, else by their list, else by their rounds."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), "o_orderkey")
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("grp"))
    return gates.match_counts(groups, orders.where("grp % 3 = 0"), orders.where("grp % 2 = 0 and o_orderkey % 2 = 0"), orders.where("o_orderkey % 5 < 2"))


@query(
    """WITH n AS (SELECT c_nationkey grp, CASE c_custkey % 4 WHEN 0 THEN 'Descansa' ELSE 'Team ' || (c_custkey % 50) END AS name FROM customer UNION SELECT s_nationkey, CASE WHEN s_suppkey % 5 > 0 THEN 'Team ' || (s_suppkey % 50) END FROM supplier)
    SELECT grp, name FROM n WHERE name <> 'Descansa'"""
)
def source_names(spark, sf_dir):
    """The teams of a group in its table or its calendar, cleaned: once each, no free rounds."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    listed = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.when(k % 4 == 0, "Descansa").when(k % 4 == 1, F.concat(F.lit("Team  "), (k % 50).cast("string"), F.lit(" (P)"))).otherwise(F.concat(F.lit("Team "), (k % 50).cast("string"))).alias("name"))
    played = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.when(s % 5 > 0, F.concat(F.lit(" Team "), (s % 50).cast("string"), F.lit(" (Clasificado)"))).alias("name"))
    names = listed.unionByName(played).select("grp", text.without_cup_marks(F.col("name")).alias("name")).distinct()
    return names.where(F.col("name").isNotNull() & ~text.is_bye(F.col("name")))


@query(
    """WITH o AS (SELECT o_orderkey k, CAST(o_orderdate AS DATE) d FROM orders)
    SELECT k, CASE k % 7 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN '-' || strftime(d, '%m-%d') WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN strftime(d, '%y-%m-%d') WHEN 4 THEN '' WHEN 5 THEN 'por fijar' ELSE '' END AS sort_key FROM o"""
)
def mixed_dates(spark, sf_dir):
    """Keys by which dates in several formats sort."""
    k = F.col("o_orderkey")
    day = lambda f: F.date_format("o_orderdate", f)
    written_as = F.when(k % 7 == 0, day("yyyy-MM-dd")).when(k % 7 == 1, day("dd/MM")).when(k % 7 == 2, day("dd/MM/yyyy")).when(k % 7 == 3, day("dd/MM/yy")).when(k % 7 == 4, "").when(k % 7 == 5, "por fijar")
    return table(spark, sf_dir, "orders").select(k.alias("k"), dates.mixed_sort_key(written_as).alias("sort_key"))
