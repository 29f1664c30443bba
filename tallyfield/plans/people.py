"""Queries on players, events and line-ups, over the event log and the conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.operators import players, publish
from tallyfield.plans.binding import EVENTS_SQL, player_events, table
from tallyfield.plans.registry import query

_APPS = f"""{EVENTS_SQL}, ec AS (SELECT match_id, player, count(*) FILTER (WHERE kind = 'goal') goals, count(*) FILTER (WHERE kind = 'yellow') yellow, count(*) FILTER (WHERE kind = 'red') red FROM player_events GROUP BY match_id, player),
    apps AS (SELECT match_id, player, CAST(player % 20 AS INT) team, CASE WHEN (match_id + player) % 3 = 0 THEN 'sub' ELSE 'starter' END AS role, CAST((player * 7 + match_id) % 30 AS INT) dorsal, goals, yellow, red FROM ec)"""


def appearances(spark, sf_dir):
    counts = players.event_counts(player_events(spark, sf_dir))
    return counts.withColumns(
        {
            "team": (F.col("player") % 20).cast("int"),
            "role": F.when((F.col("match_id") + F.col("player")) % 3 == 0, "sub").otherwise("starter"),
            "dorsal": ((F.col("player") * 7 + F.col("match_id")) % 30).cast("int"),
        }
    )


@query(f"WITH {_APPS} SELECT match_id, player, goals, yellow, red FROM ec")
def event_counts(spark, sf_dir):
    return players.event_counts(player_events(spark, sf_dir))


_SQUAD = f"{_APPS}, sq AS (SELECT team, player, count(*) apps, count(*) FILTER (WHERE role = 'starter') starts, CAST(sum(goals) AS BIGINT) goals, CAST(sum(yellow) AS BIGINT) yellow, CAST(sum(red) AS BIGINT) red FROM apps GROUP BY team, player)"


@query(f"WITH {_SQUAD} SELECT * FROM sq")
def player_aggregates(spark, sf_dir):
    return players.player_aggregates(appearances(spark, sf_dir))


@query(f"WITH {_SQUAD} SELECT team, player, apps, goals, CAST(row_number() OVER (PARTITION BY team ORDER BY goals DESC, apps DESC, CAST(player AS VARCHAR)) AS INT) seq FROM sq")
def squad_sort(spark, sf_dir):
    return players.squad_order(players.player_aggregates(appearances(spark, sf_dir)), "goals").select("team", "player", "apps", "goals", "seq")


@query(f"WITH {_APPS} SELECT player, CAST(row_number() OVER w AS INT) n, match_id, team, goals, CAST(sum(goals) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) goals_so_far FROM apps WINDOW w AS (PARTITION BY player ORDER BY match_id, team)")
def player_log(spark, sf_dir):
    rows = appearances(spark, sf_dir)
    own = rows.select("player", "team").distinct()
    return players.player_log(rows, own)


@query(f"WITH {_APPS} SELECT match_id, team, player, role, dorsal, CAST(row_number() OVER (PARTITION BY match_id, team ORDER BY role DESC, dorsal NULLS FIRST, player) AS INT) seq FROM apps")
def lineup_order(spark, sf_dir):
    return players.lineup_order(appearances(spark, sf_dir)).select("match_id", "team", "player", "role", "dorsal", "seq")


_RUN = "PARTITION BY match_id ORDER BY minute NULLS LAST, side <> 'h', event_id ROWS UNBOUNDED PRECEDING"


@query(f"WITH {EVENTS_SQL} SELECT match_id, event_id, minute, side, count(*) FILTER (WHERE side = 'h') OVER ({_RUN}) || '-' || count(*) FILTER (WHERE side = 'a') OVER ({_RUN}) AS score FROM player_events WHERE kind = 'goal'")
def running_score(spark, sf_dir):
    return players.running_score(player_events(spark, sf_dir))


@query(
    f"""WITH {EVENTS_SQL} SELECT match_id, CAST(row_number() OVER (PARTITION BY match_id ORDER BY minute NULLS LAST, event_id) AS INT) n, event_id, player, side, count(*) FILTER (WHERE side = 'h') OVER ({_RUN}) || '-' || count(*) FILTER (WHERE side = 'a') OVER ({_RUN}) AS score
    FROM player_events WHERE kind = 'goal'"""
)
def published_timelines(spark, sf_dir):
    """The goals of each match in the order in which they are published, with the score after each."""
    events = player_events(spark, sf_dir)
    goals = players.running_score(events).join(events.select("event_id", "player"), "event_id")
    lists = publish.timelines(events.select("match_id").distinct(), goals)
    return lists.select("match_id", F.posexplode("g").alias("i", "g")).select("match_id", (F.col("i") + 1).alias("n"), "g.event_id", "g.player", "g.side", "g.score")


@query(f"WITH {EVENTS_SQL} SELECT match_id, event_id, kind, minute, CAST(row_number() OVER (PARTITION BY match_id ORDER BY minute NULLS LAST, event_id) AS INT) seq FROM player_events")
def timeline_order(spark, sf_dir):
    return players.timeline(player_events(spark, sf_dir)).select("match_id", "event_id", "kind", "minute", "seq")


@query(
    f"""WITH {EVENTS_SQL}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY match_id, team, kind ORDER BY minute NULLS LAST, event_id) AS INT) n FROM player_events WHERE kind IN ('sub_in', 'sub_out')),
    f AS (SELECT match_id, team, n, event_id off_event, player off_player FROM s WHERE kind = 'sub_out'), t AS (SELECT match_id, team, n, event_id on_event, player on_player FROM s WHERE kind = 'sub_in')
    SELECT match_id, team, n, off_event, off_player, on_event, on_player FROM f FULL JOIN t USING (match_id, team, n)"""
)
def event_pairs(spark, sf_dir):
    return players.substitution_pairs(player_events(spark, sf_dir))


_SCORERS = f"{EVENTS_SQL}, sc AS (SELECT team, player, count(*) goals, count(DISTINCT match_id) games FROM player_events WHERE kind = 'goal' GROUP BY team, player)"


def scorers(spark, sf_dir):
    return player_events(spark, sf_dir).where("kind = 'goal'").groupBy("team", "player").agg(F.count("*").alias("goals"), F.countDistinct("match_id").alias("games"))


@query(f"WITH {_SCORERS} SELECT team, player, goals, games, CAST(i AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY goals DESC, games, player) i FROM sc)")
def scorers_per_group(spark, sf_dir):
    return players.top_scorers(scorers(spark, sf_dir), 1 << 30, ("team",))


@query(f"WITH {_SCORERS} SELECT * FROM sc ORDER BY goals DESC, games, team, player LIMIT 30")
def top_scorers_global(spark, sf_dir):
    return players.top_scorers(scorers(spark, sf_dir), 30)


@query(f"WITH {_SCORERS} SELECT * FROM sc ORDER BY goals DESC, games, team, player LIMIT 1")
def top_scorers(spark, sf_dir):
    return players.top_scorers(scorers(spark, sf_dir), 1)


@query(f"WITH {EVENTS_SQL} SELECT match_id, count(*) n FROM player_events WHERE match_id IN (SELECT match_id FROM player_events WHERE kind = 'goal' AND minute < 3) GROUP BY match_id")
def matches_with_events(spark, sf_dir):
    rows = player_events(spark, sf_dir)
    days = rows.groupBy("match_id").agg(F.count("*").alias("n"))
    return players.matches_with_events(days, rows.where("minute < 3"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) from_end, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) last_user FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def carry_last_user(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    w = Window.partitionBy("conv_id")
    last = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("conv_id", "turn", "role", F.row_number().over(w.orderBy(F.desc("turn"))).cast("int").alias("from_end"), last.alias("last_user"))
