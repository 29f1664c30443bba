"""Queries on report pages, tables in HTML and landed files: written from the tables, read back by the extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import dates, scores, text
from tallyfield.operators import extract, merge, publish, resolve, standings, versions
from tallyfield.plans.binding import FIXTURES_SQL, TABLE_SQL, fixtures, table
from tallyfield.plans.league import league
from tallyfield.plans.registry import query
from tallyfield.session import scratch_path, written
from tallyfield.sources import landed

_S = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _calls(number):
    """A number's digits as calls: row 1 of the table has each digit at the place this finds."""
    place = F.array(*[F.lit(extract.CALLED_DIGITS[1].index(d)) for d in range(10)])
    digits = F.filter(F.split(_S(number), ""), lambda d: d != "")
    return F.concat_ws("", F.transform(digits, lambda d: F.concat(F.lit('<script>ntype("e7", '), _S(F.get(place, d.cast("int"))), F.lit(', 1, "fa-old")</script>'))))


@query(
    """WITH r AS (SELECT o_orderkey k, CAST(year(o_orderdate) AS INT) y, o_custkey c, strftime(o_orderdate, '%d-%m-%Y') d FROM orders)
    SELECT k report_id, CASE WHEN k % 10 <> 9 THEN y || '/' || (y + 1) END season, CASE WHEN k % 10 <> 9 THEN CAST(k % 30 AS VARCHAR) END round, CASE WHEN k % 10 <> 9 THEN d END AS date, 'Team & ' || c home_team, CASE WHEN k % 10 <> 8 THEN 'Away ' || c END away_team,
    CAST(CASE WHEN k % 3 < 2 THEN k % 12 END AS INT) home_score, CAST(CASE WHEN k % 3 < 2 THEN k % 21 END AS INT) away_score, 'LIGA ' || (c % 7) competition,
    'REF ' || c referee, CASE WHEN k % 4 <> 0 THEN 'COACH ' || c END coach_home, CASE WHEN k % 5 <> 0 THEN 'OTHER ' || c END coach_away FROM r"""
)
def report_pages(spark, sf_dir):
    """Headers, scores in two disguises and staff of match reports."""
    k, c, y = F.col("o_orderkey"), _S("o_custkey"), F.year("o_orderdate")
    visible = lambda n: F.concat(F.lit('<style>.a7{color:red}</style><span style="display: none">9</span><i class="fa-solid">'), _S(n), F.lit("</i>"))
    side = lambda n: F.when(k % 3 == 0, _calls(n)).when(k % 3 == 1, visible(n)).otherwise("<i></i>")
    ficha = F.concat(F.lit('<h5 class="font-grey-cascade">Temporada '), _S(y), F.lit("-"), _S(y + 1), F.lit(" Grupo 3 Jornada "), _S(k % 30), F.lit(" <b>x</b> "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" 09:00 h</h5>"))
    absent = lambda n, name: F.when(k % n == 0, "No  presenta").otherwise(F.concat(F.lit(name), c))
    html = F.concat(
        F.when(k % 10 != 9, ficha).otherwise("<h5>-</h5>"),
        F.lit('<h4><i class="fa fa-trophy" aria-hidden="true"></i> LIGA '), _S(F.col("o_custkey") % 7), F.lit(' </h4><div class="font_widgetL">Team &amp;  '), c, F.lit("</div>"),
        F.when(k % 10 != 8, F.concat(F.lit('<div class="font_widgetV"> Away '), c, F.lit("</div>"))).otherwise(""),
        F.lit('<h2 class="ntype">'), side(k % 12), F.lit(" - "), side(k % 21), F.lit("</h2><h5><strong>Árbitro/a Principal</strong>&nbsp; REF "), c,
        F.lit("</h5><p><strong>Entrenador: </strong> "), absent(4, "COACH "), F.lit("</p><p><strong>Entrenador:</strong> "), absent(5, "OTHER "), F.lit("</p>"),
    )
    pages = written(table(spark, sf_dir, "orders").select(k.alias("report_id"), html.alias("html")), "report-pages")
    return pages.select("report_id", extract.report_header(F.col("html")).alias("h"), extract.report_staff(F.col("html")).alias("s")).select("report_id", "h.*", "s.*")


@query("SELECT p_brand team, p_name || ' ' || p_partkey player, CAST(p_size AS INT) played, CAST(p_partkey % 40 AS INT) goals FROM part")
def scorer_pages(spark, sf_dir):
    """Scorers of each brand's page."""
    one = F.concat(
        F.lit('<div><button data-bs-title="<div class=x>'), F.col("p_brand"), F.lit('<br>more</div>" data-bs-content="<b> '), F.col("p_name"), F.lit("  "), _S("p_partkey"), F.lit(' </b>">i</button> </div> <div class="btn btn-outline-primary x"> '), _S("p_size"),
        F.lit('</div><div class="btn active btn-primary y">'), _S(F.col("p_partkey") % 40), F.lit("</div>"),
    )
    pages = table(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_brand", "p_size").alias("page_id")).agg(F.concat_ws("", F.collect_list(one)).alias("html"))
    return extract.scorer_rows(pages).select("team", "player", "played", "goals")


@query(
    """WITH p AS (SELECT p_brand grp, p_name || ' ' || p_partkey player, p_partkey k, CAST(p_size AS INT) size, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 5 b FROM part),
    new AS (SELECT grp, player, CAST(k % 40 AS INT) goals, size played FROM p WHERE k % 2 = 0 AND b > 1)
    SELECT * FROM new UNION ALL SELECT grp, player, size, 1 FROM p WHERE k % 3 = 0 AND grp NOT IN (SELECT grp FROM new)"""
)
def refreshed_scorers(spark, sf_dir):
    """Scorers of a group from the reply to its page's form; groups whose page has no form or whose reply is empty keep what is stored."""
    k, b = F.col("p_partkey"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") % 5
    rows, player = table(spark, sf_dir, "part"), F.concat("p_name", F.lit(" "), _S("p_partkey"))
    stored = rows.where(k % 3 == 0).select(F.col("p_brand").alias("grp"), player.alias("player"), F.col("p_size").cast("int").alias("goals"), F.lit(1).alias("played"))
    form = F.when(b > 0, F.concat(F.lit("<a onclick=\"calendarioClasificacion('calendario_"), F.col("p_brand"), F.lit("', 3)\">")))
    tables = rows.select(F.col("p_brand").alias("grp"), F.concat(F.lit("<table></table>"), F.coalesce(form, F.lit(""))).alias("html")).distinct()
    one = F.concat(
        F.lit('<div><button data-bs-title="<div class=x>'), F.col("p_brand"), F.lit('<br></div>" data-bs-content="<b>'), player, F.lit('</b>">i</button></div><div class="btn btn-outline-primary"> '), _S("p_size"),
        F.lit('</div><div class="btn active btn-primary">'), _S(k % 40), F.lit("</div>"),
    )
    asked = F.struct(F.concat(F.lit("calendario_"), F.col("p_brand")).alias("calendar"), F.concat(F.lit("clasi_"), F.col("p_brand")).alias("table"))
    replies = rows.where(k % 2 == 0).groupBy(asked.alias("asked"), F.floor(k / 1000).alias("page")).agg(F.concat_ws("", F.collect_list(F.when(b > 1, one))).alias("html"))
    keys = tables.select("grp", extract.form_keys(F.col("html")).alias("asked")).where("asked is not null")
    pages = keys.join(replies, "asked").select(F.struct("grp", "page").alias("page_id"), "html")
    return merge.refreshed(stored, extract.scorer_rows(pages).select("page_id.grp", "player", "goals", "played"), ["grp"])


_WORD_KEY = "translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij')"


@query(f"SELECT s_nationkey page_id, 'Club ' || {_WORD_KEY} team, 'b' || s_suppkey || '.png' file, 'X' || s_suppkey code FROM supplier")
def badge_pages(spark, sf_dir):
    """Badges and codes of the teams of a page; sizes before a file's name go, the last image of a team counts."""
    team = F.concat(F.lit("Club "), F.translate(_S("s_suppkey"), "0123456789", "abcdefghij"))
    image = lambda file: F.concat(F.lit('<img src="/img/escudos/'), file, F.lit('.png" alt="" title=" Calendario '), team, F.lit(' ">'))
    link = F.concat(F.lit("<td class='local fw-bold'> "), team, F.lit(' <a href="/cal-X'), _S("s_suppkey"), F.lit('.html">c</a></td>'))
    one = F.concat(image(F.lit("old")), image(F.concat(F.lit("100x100b"), _S("s_suppkey"))), link)
    pages = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("page_id")).agg(F.concat_ws("", F.collect_list(one)).alias("html"))
    return extract.badges(pages).join(extract.team_codes(pages), ["page_id", "team"])


@query(f"WITH {TABLE_SQL} SELECT season, grp, team, points, played, won, drawn, lost, gf, ga FROM league WHERE season <> 1994")
def standings_pages(spark, sf_dir):
    """Tables in four layouts of cells; a page whose rows do not add up is left out."""
    rows = league(spark, sf_dir)
    cells = lambda *values: F.concat_ws("", *[F.concat(F.lit("<td>"), _S(v), F.lit("</td>")) for v in values])
    c = lambda n: F.col(n)
    totals = [c("played") + F.when(c("season") == 1994, 1).otherwise(0), c("won"), c("drawn"), c("lost"), c("gf"), c("ga")]
    halves = [*[F.floor(v / 2) for v in totals], *[v - F.floor(v / 2) for v in totals]]
    last = [c("gd"), F.lit("-")]
    line = F.when(c("season") % 4 == 0, cells(c("team"), c("points"), *totals, *last)).when(c("season") % 4 == 1, cells(c("position"), c("team"), c("points"), *totals, *last))
    line = line.when(c("season") % 4 == 2, cells(c("team"), c("points"), *halves, *last)).otherwise(cells(c("position"), c("team"), c("points"), *halves, *last))
    pages = rows.groupBy(F.struct("season", "grp").alias("page_id")).agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<tr>"), line, F.lit("</tr>")))).alias("html"))
    found = extract.consistent(extract.standings_rows(extract.table_rows(pages)))
    return found.select("page_id.season", "page_id.grp", "team", "points", "played", "won", "drawn", "lost", "gf", "ga")


@query(
    f"""WITH {FIXTURES_SQL} SELECT season, grp, CAST(round AS VARCHAR) round, (season + 28) || strftime(match_date, '-%m-%d') date, home, away, CASE WHEN away_score IS NOT NULL THEN home_score END home_score, CASE WHEN home_score IS NOT NULL THEN away_score END away_score
    FROM fixtures WHERE match_id % 5 < 3"""
)
def calendar_pages(spark, sf_dir):
    """Calendars of archived pages in both layouts; rows without a date or a round are left out."""
    k, c = F.col("match_id"), F.col
    cells = lambda *values: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), F.coalesce(_S(v), F.lit("-")), F.lit(" </td>")) for v in values], F.lit("</tr>"))
    day = F.concat(F.lit("Sab "), F.date_format("match_date", "dd/M/"), _S(c("season") + 28))
    seven = F.concat(cells(F.concat(F.lit("Jornada  "), _S("round"))), cells(day, F.lit("10:00"), c("home"), c("home_score"), c("away_score"), c("away"), F.lit("Campo 3")))
    nine = lambda turn, day: cells(turn, F.lit("x"), day, F.lit("10:00"), F.lit("Campo 3"), c("home"), c("home_score"), c("away_score"), c("away"))
    line = F.when(k % 5 == 0, seven).when(k % 5 < 3, nine(_S("round"), day)).when(k % 5 == 3, nine(_S("round"), F.lit("por fijar 12/3"))).otherwise(nine(F.concat(F.lit("J"), _S("round")), day))
    page = F.struct("season", "grp", F.floor(k / 100_000).alias("n")).alias("page_id")
    pages = fixtures(spark, sf_dir).groupBy(page).agg(F.concat_ws("", F.collect_list(line)).alias("html"))
    found = extract.calendar_rows(extract.table_rows(pages))
    return found.select("page_id.season", "page_id.grp", "round", "date", "home", "away", "home_score", "away_score")


@query("SELECT o_orderkey report_id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 4 < 2)")
def reports_with_content(spark, sf_dir):
    """Reports of which something is known; those with an empty header and no line-ups are purged."""
    k = F.col("o_orderkey")
    team = F.when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 > 1, F.array(F.lit("P1")))
    header = F.struct(F.when(k % 3 != 0, F.col("o_orderstatus")).alias("season"), F.lit(None).cast("string").alias("date"))
    reports = table(spark, sf_dir, "orders").select(k.alias("report_id"), header.alias("header"), F.struct(team.alias("home"), F.lit(None).cast("array<string>").alias("away")).alias("lineups"))
    return reports.where(~extract.is_empty_report()).select("report_id")


@query(f"WITH {FIXTURES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY season, grp, round, home, away ORDER BY match_id, match_date, home_score, away_score) i FROM fixtures) SELECT season, grp, round, home, away, match_id FROM r WHERE i = 1")
def first_matches(spark, sf_dir):
    """Of a page's rows with the same teams the first."""
    rows = fixtures(spark, sf_dir).select(F.struct("season", "grp", "round").alias("page_id"), F.struct("match_id", "match_date", "home_score", "away_score").alias("pos"), "home", "away")
    return extract.first_matches(rows).select("page_id.season", "page_id.grp", "page_id.round", "home", "away", "pos.match_id")


@query(f"WITH {FIXTURES_SQL} SELECT match_id, season, home, away, home_score, away_score FROM fixtures WHERE season = 1996")
def season_files(spark, sf_dir):
    """One season of a table in folders by season: the others are not read."""
    path = scratch_path(spark, "season-files")
    fixtures(spark, sf_dir).repartition("season").write.partitionBy("season").parquet(path)
    return landed.season_partition(spark, path, 1996).select("match_id", "season", "home", "away", "home_score", "away_score")


@query(f"WITH {TABLE_SQL} SELECT season, grp, team, points + CASE WHEN season = 1995 THEN 1 ELSE 0 END points FROM league WHERE season <> 1995 OR position < 4")
def rewritten_groups(spark, sf_dir):
    """A second write replaces the groups it has and leaves the rest."""
    path, rows = scratch_path(spark, "groups"), league(spark, sf_dir).select("season", "grp", "team", "position", "points")
    versions.replace_groups(rows, path, ["season"])
    versions.replace_groups(rows.where("season = 1995 and position < 4").withColumn("points", F.col("points") + 1), path, ["season"])
    return versions.read(spark, path).select("season", "grp", "team", "points")


@query(f"WITH {TABLE_SQL} SELECT season, grp, count(*) teams, CASE WHEN season = 1995 THEN 2 ELSE 1 END AS version FROM league WHERE season <> 1993 GROUP BY season, grp")
def republished_parts(spark, sf_dir):
    """Published parts with the version that wrote them: an unchanged part stays, a changed one is written again, one that is gone goes."""
    path = scratch_path(spark, "parts")
    one = lambda rows: rows.groupBy("season", "grp").agg(F.to_json(F.sort_array(F.collect_list(F.struct("team", "points")))).alias("document"))
    rows = written(league(spark, sf_dir).select("season", "grp", "team", "points"), "part-rows")
    later = rows.where("season <> 1993").withColumn("points", F.when(F.col("season") == 1995, F.col("points") + 1).otherwise(F.col("points")))
    first, _ = versions.republish(one(rows), path, ["season", "grp"])
    versions.republish(one(later), path, ["season", "grp"])
    held = versions.groups_of(spark, path).select("season", "grp", F.when(F.col("load") == first.list_id, 1).otherwise(2).alias("version"))
    return versions.read(spark, path).select("season", "grp", F.json_array_length("document").cast("long").alias("teams")).join(held, ["season", "grp"])


@query("SELECT n_nationkey, n_name, CAST(r_regionkey AS INT) region FROM nation JOIN region ON n_regionkey = r_regionkey")
def script_constants(spark, sf_dir):
    """Values of constants in script files, strings with brackets and semicolons among them."""
    path = scratch_path(spark, "scripts")
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", F.concat(F.lit('a];"}; '), "n_name").alias("name")))).alias("v"))
    rows.select(F.concat(F.lit("const OTHER = [1]; const ROWS = "), "v", F.lit(";"), F.lit(" const REGION = ["), _S("n_regionkey"), F.lit("];")).alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    files = landed.script_files(spark, path + "/*.txt").where("text <> ''")
    one = files.select(landed.script_value(F.col("text"), "ROWS", "array<struct<n_nationkey:int,name:string>>").alias("r"), landed.script_value(F.col("text"), "REGION", "array<int>")[0].alias("region"))
    return one.select(F.explode("r").alias("r"), "region").select("r.n_nationkey", F.substring("r.name", 8, 99).alias("n_name"), "region")


@query(f"WITH {TABLE_SQL} SELECT season || '' competition_id, grp group_id, CAST(position AS INT) pos, team, points pts, gf, ga gc FROM league")
def scraped_files(spark, sf_dir):
    """Tables of scraped groups from nested JSON files, one object a file."""
    path = scratch_path(spark, "scraped")
    nested = publish.standings_arrays(league(spark, sf_dir)).select(_S("season").alias("competition_id"), F.col("grp").alias("group_id"), F.col("grp").alias("group_name"), "standings")
    nested.repartition("competition_id", "group_id").write.option("maxRecordsPerFile", 1).json(path)
    return landed.scraped_standings(landed.scraped_groups(spark, path)).select("competition_id", "group_id", "pos", "team", "pts", "gf", "gc")


@query("SELECT '<p>' || n_name || ' ñ</p>' html FROM nation")
def landed_files(spark, sf_dir):
    """Pages from the files they landed in."""
    path = scratch_path(spark, "landed")
    table(spark, sf_dir, "nation").select(F.concat(F.lit("<p>"), "n_name", F.lit(" ñ</p>")).alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return landed.landed_pages(spark, path + "/*.txt").where("html <> ''").select(text.squeezed(F.col("html")).alias("html"))


@query(f"WITH {TABLE_SQL} SELECT season, grp, team, position pos, points pts, played j, gf, ga gc FROM league")
def published_tables(spark, sf_dir):
    """The tables of the published documents, read back from their JSON."""
    rows = fixtures(spark, sf_dir)
    documents = publish.category_documents(standings.league_table(rows), rows)
    schema = "season int, grp string, standings array<struct<pos:int,team:string,pts:int,j:int,gf:int,gc:int>>"
    return documents.select(F.from_json("document", schema).alias("d")).select("d.season", "d.grp", F.explode("d.standings").alias("s")).select("season", "grp", "s.*")


@query(f"WITH {FIXTURES_SQL} SELECT season, grp, round, match_id, home, away, home_score hs, away_score \"as\" FROM fixtures")
def published_rounds(spark, sf_dir):
    """The fixtures of the published documents, read back from their JSON."""
    rows = fixtures(spark, sf_dir)
    documents = publish.category_documents(standings.league_table(rows), rows)
    schema = "season int, grp string, rounds array<struct<round:int,matches:array<struct<match_id:long,home:string,away:string,hs:int,as:int>>>>"
    out = documents.select(F.from_json("document", schema).alias("d")).select("d.season", "d.grp", F.explode("d.rounds").alias("r")).select("season", "grp", "r.round", F.explode("r.matches").alias("m"))
    return out.select("season", "grp", "round", "m.*")


@query(
    """WITH s AS (SELECT c_custkey % 30 scraped, c_nationkey stored, count(*) / 60 roster, (c_custkey % 30 + c_nationkey) % 10 / 10 schedule FROM customer GROUP BY c_custkey % 30, c_nationkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY scraped ORDER BY roster DESC, schedule DESC, stored DESC) i FROM s WHERE schedule >= 0.7) SELECT scraped, stored, roster, schedule FROM r WHERE i = 1 AND roster >= 0.02"""
)
def best_groups(spark, sf_dir):
    """For scraped groups the stored one whose roster overlaps most, if the schedule overlaps enough."""
    pairs = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 30).alias("scraped"), F.col("c_nationkey").alias("stored")).agg((F.count("*") / 60).alias("roster"))
    pairs = pairs.withColumn("schedule", (F.col("scraped") + F.col("stored")) % 10 / 10)
    return resolve.best_groups(pairs.select("scraped", "stored", F.col("roster").alias("overlap")), pairs.select("scraped", "stored", F.col("schedule").alias("overlap")), least_roster=0.02)


@query(
    r"""SELECT s_suppkey id, CASE s_suppkey % 4 WHEN 0 THEN 'Club ' || s_suppkey WHEN 1 THEN 'Club ' || s_suppkey WHEN 2 THEN 'Club "B"' ELSE 'Club ' || s_suppkey END AS name,
    CASE s_suppkey % 3 WHEN 0 THEN TIMESTAMP '2025-03-09 10:30:00' END kickoff FROM supplier"""
)
def cleaned_names(spark, sf_dir):
    """Cup notes and doubled letters in names; kick-off times whose year stands for unknown."""
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("Club "), _S(k), F.lit(" (Clasificado)"))).when(k % 4 == 1, F.concat(F.lit("Club (P) "), _S(k))).when(k % 4 == 2, 'Club B "B"').otherwise(F.concat(F.lit("Club  "), _S(k), F.lit(" (ganador)")))
    when = F.when(k % 3 == 0, "2025-03-09T10:30:00Z").when(k % 3 == 1, "0001-01-01T00:00:00Z").otherwise("soon")
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), raw.alias("raw"), when.alias("t"))
    return rows.select("id", text.single_quoted_letter(text.without_cup_marks(F.col("raw"))).alias("name"), dates.kickoff(F.col("t")).cast("timestamp_ntz").alias("kickoff"))


@query(f"WITH {FIXTURES_SQL} SELECT season, grp, round, count(*) n, count(*) FILTER (WHERE home_score IS NOT NULL AND away_score IS NOT NULL) played FROM fixtures WHERE upper(grp) = 'REGION_1' OR upper(grp) LIKE 'A%' GROUP BY season, grp, round")
def category_filter(spark, sf_dir):
    """A category by its name in any case; rounds of finished seasons without the fixtures that were not played."""
    rows = fixtures(spark, sf_dir).where((F.upper("grp") == "REGION_1") | F.upper("grp").startswith("A"))
    return rows.groupBy("season", "grp", "round").agg(F.count("*").alias("n"), F.count_if(scores.played()).alias("played"))
