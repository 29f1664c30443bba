"""Queries on names, dates, pages and entity resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions import dates, text
from tallyfield.operators import extract, resolve
from tallyfield.plans.binding import FIXTURES_SQL, fixtures, table
from tallyfield.plans.registry import query
from tallyfield.session import written

TODAY = "1998-03-10"
_NAMES = """nm AS (SELECT c_custkey id, CASE WHEN c_custkey % 97 = 0 THEN 'C.D.' WHEN c_custkey % 89 = 0 THEN 'Real Club' WHEN c_custkey % 83 = 0 THEN ' Descansan ' ELSE
    CASE c_custkey % 6 WHEN 0 THEN 'C.D. ' WHEN 1 THEN 'AFC ' ELSE '' END || 'Customer' || CASE c_custkey % 4 WHEN 0 THEN ' F.C. ' WHEN 1 THEN '-' WHEN 2 THEN ' Ñú de ' ELSE '  ' END || (c_custkey // 6)
    || CASE c_custkey % 5 WHEN 0 THEN ' A' WHEN 1 THEN ' B' WHEN 2 THEN ' "F"' ELSE '' END || CASE c_custkey % 7 WHEN 0 THEN ', U.D.' WHEN 1 THEN ' "B"' ELSE '' END END AS name FROM customer)"""


def names(spark, sf_dir):
    """Team-like names in the spellings that normalisers must bring together, or keep apart."""
    k = F.col("c_custkey")
    start = F.when(k % 6 == 0, "C.D. ").when(k % 6 == 1, "AFC ").otherwise("")
    middle = F.when(k % 4 == 0, " F.C. ").when(k % 4 == 1, "-").when(k % 4 == 2, " Ñú de ").otherwise("  ")
    end = F.concat(F.when(k % 5 == 0, " A").when(k % 5 == 1, " B").when(k % 5 == 2, ' "F"').otherwise(""), F.when(k % 7 == 0, ", U.D.").when(k % 7 == 1, ' "B"').otherwise(""))
    name = F.concat(start, F.lit("Customer"), middle, F.floor(k / 6).cast("string"), end)
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 97 == 0, "C.D.").when(k % 89 == 0, "Real Club").when(k % 83 == 0, " Descansan ").otherwise(name).alias("name"))


_SP = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_FOLD = _SP.format("regexp_replace(upper(strip_accents({})), '[^A-Z0-9]+', ' ', 'g')")
_WORDS = r"'\b(" + "|".join(text.CLUB_WORDS) + r")\b'"
_TEAM = _SP.format(rf"regexp_replace(lower(strip_accents(regexp_replace(name, '[\"''‘’“”.,;:]', ' ', 'g'))), {_WORDS}, ' ', 'g')")
_RECONCILED = _SP.format(rf"regexp_replace({_TEAM}, '\b[abcd]\b\s*$', '')")
_BADGE = _SP.format(r"lower(regexp_replace(regexp_replace(strip_accents(name), '[\"'',.‘’“”]', '', 'g'), '(?i)\b(" + "|".join(text.BADGE_TOKENS) + r")\b', '', 'g'))")
_UNDOTTED = _FOLD.format(r"regexp_replace(name, '\b(?:[A-Za-z]\.){2,}', ' ', 'g')")


@query(f"WITH {_NAMES} SELECT id, {_BADGE} badge, {_TEAM} team, {_RECONCILED} reconciliation, {_FOLD.format('name')} folded, upper({_SP.format('strip_accents(name)')}) player FROM nm")
def name_keys(spark, sf_dir):
    n = F.col("name")
    return names(spark, sf_dir).select("id", text.badge_key(n).alias("badge"), text.team_key(n).alias("team"), text.reconciliation_key(n).alias("reconciliation"), text.folded(n).alias("folded"), text.player_key(n).alias("player"))


@query(f"WITH {_NAMES}, k AS (SELECT id, {_TEAM} AS key FROM nm) SELECT key, min(id) canonical_id, count(*) spellings FROM k GROUP BY key")
def canonical_ids(spark, sf_dir):
    return resolve.canonical_ids(names(spark, sf_dir).select("id", text.team_key(F.col("name")).alias("key")))


@query(f"WITH {_NAMES}, k AS (SELECT id, {_RECONCILED} AS key FROM nm) SELECT a.id, b.id other FROM k a JOIN k b ON a.key = b.key WHERE a.id < b.id")
def name_equality_join(spark, sf_dir):
    k = names(spark, sf_dir).select("id", text.reconciliation_key(F.col("name")).alias("key"))
    return resolve.equal_pairs(k)


@query(
    r"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name || ' ' || p_partkey || ' "' || p_type || '"' END AS name, p_brand FROM part),
    w AS (SELECT *, string_split_regex(trim(regexp_replace(name, '[^a-zA-ZáéíóúñÁÉÍÓÚÑüÜ\s]', '', 'g')), '\s+') ws FROM n)
    SELECT p_partkey, name, upper(CASE WHEN len(ws) = 1 THEN left(ws[1], 2) ELSE left(ws[1], 1) || left(ws[2], 1) || coalesce(left(ws[3], 1), '') END) initials,
    replace(replace(replace(replace(replace(name || ' & <' || p_brand || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') escaped FROM w"""
)
def display_names(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.concat(F.col("p_name"), F.lit(" "), k.cast("string"), F.lit(' "'), F.col("p_type"), F.lit('"')))
    rows = table(spark, sf_dir, "part").select(k, name.alias("name"), "p_brand")
    shown = F.concat("name", F.lit(" & <"), "p_brand", F.lit(">"))
    return rows.select("p_partkey", "name", text.initials(F.col("name")).alias("initials"), text.html_escaped(shown).alias("escaped"))


_TOKENS = "nm AS (SELECT DISTINCT p_name || ' ' || p_type name FROM part), tk AS (SELECT name, list_distinct(string_split(lower(name), ' ')) t FROM nm)"


@query(f"WITH {_TOKENS}, m AS (SELECT a.name a, b.name b, list_intersect(a.t, b.t) x, a.t ta, b.t tb FROM tk a JOIN tk b ON a.name < b.name) SELECT a, b FROM m WHERE len(x) >= 2 AND len(list_filter(x, lambda w: length(w) >= 5)) > 0 OR lower(a) = lower(b) OR (least(length(a), length(b)) >= 5 AND (starts_with(lower(a), lower(b)) OR starts_with(lower(b), lower(a))))")
def token_set_match(spark, sf_dir):
    """Names that the reconciliation rules call the same, among names that share a word."""
    rows = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_type").alias("name")).distinct()
    token = lambda n: rows.select(F.col("name").alias(n), F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("w"))
    pairs = token("a").join(token("b"), "w").where("a < b").select("a", "b").distinct()
    return pairs.where(resolve.names_match(F.lower("a"), F.lower("b")))


@query()
def roster_assignment(spark, sf_dir):
    """One-to-one names of two rosters in each group: greedy, so there is no one SQL statement for it."""
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("grp"), "p_name", "p_type")
    left = rows.select("grp", F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()
    right = rows.select("grp", F.concat_ws(" ", "p_type", "p_name").alias("name")).distinct()
    return resolve.greedy_assignment(resolve.scored_pairs(left, right, ("grp",)), ("grp",)).select("grp", "a", "b", F.round("score", 6).alias("score"))


@query(
    r"""WITH s AS (SELECT s_suppkey k, s_nationkey g, s_nationkey % 5 season, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) i, translate(md5(CAST(s_suppkey AS VARCHAR)), '0123456789', 'ghijklmnop') w FROM supplier),
    t AS (SELECT *, upper(substr(w, 1, 7)) a, upper(substr(w, 8, 6)) b FROM s),
    n AS (SELECT season, g, k, i, a || ' ' || b || ' "B"' AS name, CASE WHEN i % 4 = 3 THEN 'season' ELSE 'roster' END stage, a || ' ' || b || ' B' canonical FROM t
      UNION ALL SELECT season, g, k, i, a || ' ' || b || ', C.D. "B"', CASE WHEN i % 4 = 3 THEN 'season' ELSE 'roster' END, a || ' ' || b || ' B' FROM t WHERE i % 2 = 0)
    SELECT season, g grp, name, canonical, stage FROM n"""
)
def canonical_team_names(spark, sf_dir):
    """Stored names for scraped ones: a group's roster for most, variants as one, the season's other teams for the rest."""
    k = F.col("s_suppkey")
    i = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    w = F.translate(F.md5(k.cast("string").cast("binary")), "0123456789", "ghijklmnop")
    rows = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("season"), F.col("s_nationkey").alias("grp"), F.upper(F.substring(w, 1, 7)).alias("a"), F.upper(F.substring(w, 8, 6)).alias("b"), i.alias("i"))
    named = lambda *parts: F.concat("a", F.lit(" "), "b", *[F.lit(p) for p in parts])
    scraped = rows.select("season", "grp", named(' "B"').alias("name")).unionByName(rows.where("i % 2 = 0").select("season", "grp", named(', C.D. "B"').alias("name")))
    stored = rows.withColumn("name", named(" B"))
    return resolve.canonical_names(scraped, stored.where("i % 4 <> 3").select("season", "grp", "name"), stored.select("season", "name"))


#: Match ids that a nation's club plays in: the clubs of a season grow with the data, the meetings of two clubs do not.
_CLUB = 20_000
_REPORTS = f"""{FIXTURES_SQL}, x AS (SELECT *, substr(md5(home || '/' || match_id // {_CLUB}), 1, 7) || ' norte ' || substr(md5(home || '/' || match_id // {_CLUB}), 8, 4) hk, substr(md5(away || '/' || match_id // {_CLUB}), 1, 7) || ' norte ' || substr(md5(away || '/' || match_id // {_CLUB}), 8, 4) ak, match_id * 100 + row_number() OVER (PARTITION BY match_id ORDER BY season, round, home, away, match_date, home_score, away_score) report_id FROM fixtures),
    rp AS (SELECT report_id, match_id true_id, season, round, CASE report_id % 4 WHEN 1 THEN left(hk, 11) WHEN 2 THEN substr(hk, 15) || ' norte ' || left(hk, 7) WHEN 3 THEN CASE WHEN report_id % 8 = 3 THEN left(hk, 7) || ' otro' ELSE '' END ELSE hk END hk, ak,
      CASE WHEN match_id % 7 = 0 THEN NULL ELSE match_date + CAST(match_id % 4 AS INT) END match_date, CASE WHEN match_id % 5 = 0 THEN NULL ELSE home_score END hs, away_score ays FROM x)"""
_MATCHING = """(a = b OR (length(b) >= 5 AND starts_with(a, b)) OR (length(a) >= 5 AND starts_with(b, a)) OR (len(list_intersect(list_filter(string_split(a, ' '), lambda w: length(w) > 1), list_filter(string_split(b, ' '), lambda w: length(w) > 1))) >= 2
      AND len(list_filter(list_intersect(string_split(a, ' '), string_split(b, ' ')), lambda w: length(w) >= 5)) > 0))"""
_RECONCILED_SQL = f"""{_REPORTS}, hm AS (SELECT a, b FROM (SELECT DISTINCT hk a FROM rp WHERE hk <> '') CROSS JOIN (SELECT DISTINCT hk b FROM x) WHERE {_MATCHING}), am AS (SELECT a, b FROM (SELECT DISTINCT ak a FROM rp) CROSS JOIN (SELECT DISTINCT ak b FROM x) WHERE {_MATCHING}),
    p AS (SELECT rp.report_id, x.match_id, CASE WHEN rp.match_date IS NOT NULL THEN abs(datediff('day', x.match_date, rp.match_date)) <= 1 END d, CASE WHEN hs IS NOT NULL AND ays IS NOT NULL AND x.home_score IS NOT NULL AND x.away_score IS NOT NULL THEN hs = x.home_score AND ays = x.away_score END s
      FROM rp JOIN hm ON rp.hk = hm.a JOIN am ON rp.ak = am.a JOIN x ON x.season = rp.season AND x.hk = hm.b AND x.ak = am.b),
    ag AS (SELECT report_id, count(*) n, min(match_id) only_, bool_and(coalesce(d, TRUE) AND coalesce(s, TRUE)) fits, count(*) FILTER (WHERE d) nd, min(match_id) FILTER (WHERE d) bd, count(*) FILTER (WHERE s) ns, min(match_id) FILTER (WHERE s) bs, count(*) FILTER (WHERE d AND s) nb, min(match_id) FILTER (WHERE d AND s) bb FROM p GROUP BY report_id),
    rec AS (SELECT rp.report_id, CASE WHEN n = 1 THEN CASE WHEN fits THEN only_ END WHEN nd = 1 THEN bd WHEN nd = 0 AND ns = 1 THEN bs WHEN nd > 1 AND nb = 1 THEN bb END match_id FROM rp LEFT JOIN ag USING (report_id))"""


def _reports(spark, sf_dir):
    """Reports of all fixtures, their home names cut, turned round, half another's or missing; and the fixtures."""
    club = lambda c: F.md5(F.concat(F.col(c), F.lit("/"), F.floor(F.col("match_id") / _CLUB).cast("string")).cast("binary"))
    key = lambda c: F.concat(F.substring(club(c), 1, 7), F.lit(" norte "), F.substring(club(c), 8, 4))
    turn = F.row_number().over(Window.partitionBy("match_id").orderBy("season", "round", "home", "away", "match_date", F.asc_nulls_last("home_score"), F.asc_nulls_last("away_score")))
    rows = fixtures(spark, sf_dir).withColumns({"report_id": F.col("match_id") * 100 + turn, "home_key": key("home"), "away_key": key("away")})
    rows = written(rows.select("match_id", "report_id", "season", "round", "home_key", "away_key", "match_date", "home_score", "away_score"), "report-fixtures")
    k, h = F.col("report_id"), F.col("home_key")
    other = F.when(k % 8 == 3, F.concat(F.substring(h, 1, 7), F.lit(" otro"))).otherwise("")
    reports = rows.select(
        "report_id", "season", "round", "away_key",
        F.when(k % 4 == 1, F.substring(h, 1, 11)).when(k % 4 == 2, F.concat(F.substring(h, 15, 99), F.lit(" norte "), F.substring(h, 1, 7))).when(k % 4 == 3, other).otherwise(h).alias("home_key"),
        F.when(F.col("match_id") % 7 != 0, F.date_add("match_date", (F.col("match_id") % 4).cast("int"))).alias("match_date"),
        F.when(F.col("match_id") % 5 != 0, F.col("home_score")).alias("home_score"), "away_score",
    )
    return reports, rows.select("match_id", "season", "round", "home_key", "away_key", "match_date", "home_score", "away_score")


@query(f"WITH {_RECONCILED_SQL} SELECT report_id, match_id FROM rec")
def reconciled_reports(spark, sf_dir):
    """Reports to fixtures: by equal names, by a cut name, by words in another order; ambiguous ones by day and score."""
    return resolve.reconcile(*_reports(spark, sf_dir), ("season",))


@query(f"WITH {_RECONCILED_SQL}, c AS (SELECT report_id, row_number() OVER (PARTITION BY match_id ORDER BY report_id) turn FROM rec WHERE match_id IS NOT NULL), q AS (SELECT rp.report_id, CASE WHEN hk = '' OR ak = '' THEN 'no names' WHEN turn IS NULL THEN 'no match' WHEN turn > 1 THEN 'match taken' END reason FROM rp LEFT JOIN c USING (report_id)) SELECT report_id, reason FROM q WHERE reason IS NOT NULL")
def quarantined_reports(spark, sf_dir):
    """Reports that no fixture took, with the reason."""
    reports, known = _reports(spark, sf_dir)
    return resolve.quarantined(reports, resolve.reconcile(reports, known, ("season",)))


@query("WITH o AS (SELECT o_orderkey m, o_orderkey r FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey m, o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END r FROM orders WHERE o_orderkey % 10 <> 6) SELECT o.m match_id, o.r cleared, t.r given FROM o JOIN n ON o.r = n.r LEFT JOIN n t ON o.m = t.m WHERE o.m <> n.m")
def stale_assignments(spark, sf_dir):
    """Reports that moved to another match: the old match is cleared and may hold another one."""
    k = F.col("o_orderkey")
    keys = table(spark, sf_dir, "orders").select(k)
    before = keys.where(k % 3 != 0).select(k.alias("match_id"), k.alias("report_id"))
    after = keys.where(k % 10 != 6).select(k.alias("match_id"), (k + F.when(k % 5 == 0, 1).otherwise(0)).alias("report_id"))
    return resolve.reassigned(before, after)


@query(
    f"""WITH {_NAMES}, t AS (SELECT id, name, {_BADGE} AS key, id % 7 + 2018 last_season, id % 11 played FROM nm), l AS (SELECT DISTINCT id % 40 grp, id, key FROM t),
    bad AS (SELECT DISTINCT key FROM (SELECT key, grp FROM l GROUP BY key, grp HAVING count(*) > 1)),
    r AS (SELECT *, row_number() OVER w n, first_value(id) OVER w stays FROM t WHERE key NOT IN (SELECT key FROM bad) WINDOW w AS (PARTITION BY key ORDER BY last_season DESC, played DESC, encode(name), id))
    SELECT key, stays, id goes FROM r WHERE n > 1"""
)
def colliding_teams(spark, sf_dir):
    """Teams whose badge keys agree: the one of the newest season stays, unless two are listed together."""
    k = F.col("id")
    teams = names(spark, sf_dir).select(text.badge_key(F.col("name")).alias("key"), "id", "name", (k % 7 + 2018).alias("last_season"), (k % 11).alias("played"))
    return resolve.colliding(teams, teams.select((k % 40).alias("grp"), "id"))


_DATE_TEXT = "CASE l_orderkey % 4 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%d-%m-%Y') WHEN 2 THEN strftime(l_shipdate, '%d/%m') ELSE '' END"


def _date_text():
    k = F.col("l_orderkey") % 4
    day = F.col("l_shipdate")
    return F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd-MM-yyyy")).when(k == 2, F.date_format(day, "dd/MM")).otherwise("")


@query(f"WITH t AS (SELECT {_DATE_TEXT} txt FROM lineitem) SELECT coalesce(CAST(try_strptime(txt, '%d/%m/%Y') AS DATE), CAST(try_strptime(txt, '%d-%m-%Y') AS DATE), CAST(try_strptime(txt, '%Y-%m-%d') AS DATE), CAST(try_strptime(txt, '%Y/%m/%d') AS DATE)) AS parsed, count(*) n FROM t GROUP BY 1")
def date_parse(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(dates.parsed_date(_date_text()).alias("parsed")).groupBy("parsed").agg(F.count("*").alias("n"))


@query(
    f"""WITH t AS (SELECT DISTINCT strftime(l_shipdate, '%d/%m') txt FROM lineitem), p AS (SELECT txt, CAST(try_strptime(txt || '/1998', '%d/%m/%Y') AS DATE) y0, CAST(try_strptime(txt || '/1999', '%d/%m/%Y') AS DATE) y1, CAST(try_strptime(txt || '/1997', '%d/%m/%Y') AS DATE) ym FROM t)
    SELECT txt, CASE WHEN datediff('day', DATE '{TODAY}', y0) < -180 THEN y1 WHEN datediff('day', DATE '{TODAY}', y0) > 180 THEN ym ELSE y0 END AS resolved FROM p"""
)
def dmy_year_resolution(spark, sf_dir):
    texts = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "dd/MM").alias("txt")).distinct()
    return texts.select("txt", dates.resolved_day_month(F.col("txt"), F.lit(TODAY).cast("date")).alias("resolved"))


@query(f"SELECT DISTINCT CAST(l_shipdate AS DATE) AS ship_day, CASE datediff('day', DATE '{TODAY}', CAST(l_shipdate AS DATE)) WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' ELSE 'in ' || datediff('day', DATE '{TODAY}', CAST(l_shipdate AS DATE)) || ' days' END AS label FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '{TODAY}'")
def countdown(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("ship_day")).distinct()
    return days.select("ship_day", dates.countdown(F.col("ship_day"), F.lit(TODAY).cast("date")).alias("label")).where("label is not null")


@query("WITH t AS (SELECT DISTINCT 'Sat ' || strftime(l_shipdate, '%d.%m') || ' of ' || (year(l_shipdate) + 26) txt FROM lineitem) SELECT txt, regexp_extract(txt, '(\\d\\d)\\.(\\d\\d)', 1) || '/' || regexp_extract(txt, '(\\d\\d)\\.(\\d\\d)', 2) short, regexp_extract(txt, '(20\\d\\d)', 1) || '-' || regexp_extract(txt, '(\\d\\d)\\.(\\d\\d)', 2) || '-' || regexp_extract(txt, '(\\d\\d)\\.(\\d\\d)', 1) iso FROM t")
def ragged_dates(spark, sf_dir):
    txt = F.concat(F.lit("Sat "), F.date_format("l_shipdate", "dd.MM"), F.lit(" of "), (F.year("l_shipdate") + 26).cast("string"))
    return table(spark, sf_dir, "lineitem").select(txt.alias("txt")).distinct().select("txt", dates.reformatted(F.col("txt"), "dd/MM").alias("short"), dates.reformatted(F.col("txt"), "iso").alias("iso"))


@query(f"WITH {FIXTURES_SQL}, d AS (SELECT DISTINCT home, away, match_date FROM fixtures) SELECT a.home, a.away, a.match_date, b.match_date other_date FROM d a JOIN d b ON a.home = b.home AND a.away = b.away AND a.match_date < b.match_date AND datediff('day', a.match_date, b.match_date) <= 1")
def date_window_match(spark, sf_dir):
    """Fixtures of the same teams a day apart: days are binned to an equi key first, so nothing is a cross product."""
    rows = fixtures(spark, sf_dir).select("home", "away", "match_date").distinct()
    near = rows.withColumn("other_date", F.explode(F.array(F.date_add("match_date", 1))))
    return near.join(rows.withColumnRenamed("match_date", "other_date"), ["home", "away", "other_date"]).select("home", "away", "match_date", "other_date")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS INT) n_links FROM pages")
def html_title_links(spark, sf_dir):
    count = F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(extract.title(F.col("html")), F.lit("")).alias("title"), count.alias("n_links"))


@query("SELECT href, count(DISTINCT page_id) pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) href FROM pages) WHERE regexp_matches(href, '^/[a-z]+$') GROUP BY href")
def discovered_links(spark, sf_dir):
    return extract.discovered(table(spark, sf_dir, "pages"), r"^/[a-z]+$")


@query(
    """WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|p)>[^<]*')) x, generate_subscripts(regexp_extract_all(html, '<(?:h1|p)>[^<]*'), 1) - 1 pos FROM pages),
    h AS (SELECT page_id, pos, x, last_value(CASE WHEN x LIKE '<h1>%' THEN substr(x, 5) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) header FROM e)
    SELECT page_id, header, count(*) n_paragraphs FROM h WHERE x LIKE '<p>%' GROUP BY page_id, header"""
)
def html_rows_carry_header(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(?:h1|p)>[^<]*"), F.lit(0))).alias("pos", "x"))
    order = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("x").startswith("<h1>"), F.substring("x", 5, 1 << 30)), ignorenulls=True).over(order)
    return found.withColumn("header", header).where(F.col("x").startswith("<p>")).groupBy("page_id", "header").agg(F.count("*").alias("n_paragraphs"))


@query(
    f"""WITH {_NAMES}, f AS (SELECT id, name, {_UNDOTTED} u, {_FOLD.format("name")} whole FROM nm), t AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(u, '( [A-F])+$', ''), ' '), lambda w: w <> '')) ws FROM f),
    c AS (SELECT *, list_filter(ws, lambda w: length(w) > 1 AND w NOT IN {text.NOISE}) core FROM t)
    SELECT id, nullif(regexp_extract(u, ' ([A-F])$', 1), '') filial, coalesce(list_aggregate(list_sort(CASE WHEN len(core) > 0 THEN core ELSE ws END), 'string_agg', ' '), '') tokens, whole IN {text.BYE_WORDS} bye FROM c"""
)
def name_tokens(spark, sf_dir):
    n = F.col("name")
    return names(spark, sf_dir).select("id", text.filial(n).alias("filial"), F.concat_ws(" ", F.array_sort(text.core_tokens(n))).alias("tokens"), text.is_bye(n).alias("bye"))


_SLUGS = "sl AS (SELECT c_custkey id, (c_custkey % 3) || CASE c_custkey % 6 WHEN 0 THEN 'benjamin' WHEN 1 THEN 'prebenjamin' WHEN 2 THEN 'lanzarote' WHEN 3 THEN 'benjaminfv' WHEN 4 THEN 'benjamin' ELSE 'segunda' END || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE (c_custkey % 20)::VARCHAR END slug FROM customer)"


@query(
    rf"""WITH {_SLUGS} SELECT id, slug, coalesce('P' || nullif(regexp_extract(slug, '^1benjamin(\d+)$', 1), ''), 'PGC' || nullif(regexp_extract(slug, '^1prebenjamin(\d+)$', 1), ''), upper(slug)) code,
    CASE WHEN slug LIKE '%lanzarote%' THEN 'Lanzarote' WHEN slug LIKE '%fv%' THEN 'Fuerteventura' WHEN slug LIKE '2%' OR slug LIKE '%segunda%' THEN 'Segunda Fase GC' ELSE 'Primera Fase GC' END phase,
    CASE WHEN slug LIKE '%lanzarote%' THEN 'lanzarote' WHEN slug LIKE '%fv%' THEN 'fuerteventura' ELSE 'grancanaria' END island, 'Grupo ' || coalesce(nullif(regexp_extract(slug, '(\d+)$', 1), ''), '?') AS label FROM sl"""
)
def slug_meanings(spark, sf_dir):
    """What page slugs say: code, phase, island and label."""
    k = F.col("c_custkey")
    kind = F.when(k % 6 == 1, "prebenjamin").when(k % 6 == 2, "lanzarote").when(k % 6 == 3, "benjaminfv").when(k % 6 == 5, "segunda").otherwise("benjamin")
    slugs = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat((k % 3).cast("string"), kind, F.when(k % 4 == 0, "").otherwise((k % 20).cast("string"))).alias("slug"))
    s = F.col("slug")
    return slugs.select("id", "slug", text.slug_code(s).alias("code"), text.slug_phase(s).alias("phase"), text.slug_island(s).alias("island"), text.slug_label(s).alias("label"))


@query(
    r"""WITH g AS (SELECT c_custkey id, CASE c_custkey % 5 WHEN 0 THEN 'PREBENJAMIN' ELSE 'BENJAMIN' END category, CASE c_custkey % 5 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Prebenjamin Primera G-' || (c_custkey % 9) ELSE 'Prebenjamin Liga' END
      WHEN 1 THEN 'Benjamin Fuerteventura Liga Oro' WHEN 2 THEN 'Benjamin Lanzarote Grupo ' || (c_custkey % 9) WHEN 3 THEN 'Benjamin Lanzarote Final' ELSE 'Segunda Fase Benjamin A-G' || (c_custkey % 9) END AS name FROM customer),
    u AS (SELECT *, upper(name) u, 'BENJAMIN ' || trim(regexp_replace(upper(name), '\bBENJAMIN\b\s*', '', 'g')) bare FROM g)
    SELECT id, name, CASE WHEN category = 'PREBENJAMIN' THEN CASE WHEN regexp_matches(u, 'G-?\d') THEN 'PREBENJAMIN GC GRUPO ' || regexp_extract(u, 'G-?(\d+)', 1) ELSE u END
      WHEN u LIKE '%FUERTEVENTURA%' THEN bare WHEN u LIKE '%LANZAROTE%' AND regexp_matches(u, 'GRUPO\s*\d') THEN 'BENJAMIN PRIMERA LANZAROTE G' || regexp_extract(u, 'GRUPO\s*(\d+)', 1) ELSE bare END shown,
      CASE WHEN u LIKE '%LANZAROTE%' THEN '🌋' WHEN u LIKE '%FUERTEVENTURA%' THEN '🏝️' ELSE '⚽' END sign FROM u"""
)
def shown_groups(spark, sf_dir):
    """Group names as scorer lists show them, and the sign of their phase."""
    k, n = F.col("c_custkey"), (F.col("c_custkey") % 9).cast("string")
    small = F.when(k % 2 == 0, F.concat(F.lit("Prebenjamin Primera G-"), n)).otherwise("Prebenjamin Liga")
    name = F.when(k % 5 == 0, small).when(k % 5 == 1, "Benjamin Fuerteventura Liga Oro").when(k % 5 == 2, F.concat(F.lit("Benjamin Lanzarote Grupo "), n)).when(k % 5 == 3, "Benjamin Lanzarote Final").otherwise(F.concat(F.lit("Segunda Fase Benjamin A-G"), n))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"), F.when(k % 5 == 0, "PREBENJAMIN").otherwise("BENJAMIN").alias("category"))
    return rows.select("id", "name", text.shown_group(F.col("name"), F.col("category")).alias("shown"), text.phase_sign(F.col("name")).alias("sign"))


@query(
    r"""WITH r AS (SELECT c_custkey id, CASE c_custkey % 7 WHEN 0 THEN '( Semifinales )' WHEN 1 THEN 'Ronda ' || (c_custkey % 12) WHEN 2 THEN '01-02-2024 Gran Final' WHEN 3 THEN 'Previa' WHEN 4 THEN '01-02-2024 Partidos' WHEN 5 THEN 'Cuartos de final' ELSE 'Dieciseisavos' END AS label, CAST(c_custkey % 6 AS INT) d FROM customer)
    SELECT id, label, d to_final, CASE WHEN regexp_matches(label, '(?i)previa') THEN 'Previa' WHEN regexp_matches(label, '(?i)dieciseis') THEN 'Dieciseisavos' WHEN regexp_matches(label, '(?i)octavos') THEN 'Octavos' WHEN regexp_matches(label, '(?i)cuartos') THEN 'Cuartos' WHEN regexp_matches(label, '(?i)semifinal') THEN 'Semifinales' WHEN regexp_matches(label, '(?i)\bfinal\b') THEN 'Final'
      WHEN d = 0 THEN 'Final' WHEN d = 1 THEN 'Semifinales' WHEN d = 2 THEN 'Cuartos' WHEN d = 3 THEN 'Octavos' WHEN regexp_matches(label, '(?i)ronda\s+\d') THEN 'Ronda ' || regexp_extract(label, '(?i)ronda\s+(\d+)', 1) ELSE trim(regexp_replace(label, '\d{2}-\d{2}-\d{4}\s*', '')) END AS name FROM r"""
)
def round_names(spark, sf_dir):
    k = F.col("c_custkey")
    label = F.when(k % 7 == 0, "( Semifinales )").when(k % 7 == 1, F.concat(F.lit("Ronda "), (k % 12).cast("string"))).when(k % 7 == 2, "01-02-2024 Gran Final").when(k % 7 == 3, "Previa").when(k % 7 == 4, "01-02-2024 Partidos").when(k % 7 == 5, "Cuartos de final").otherwise("Dieciseisavos")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), label.alias("label"), (k % 6).cast("int").alias("to_final"))
    return rows.select("id", "label", "to_final", text.round_name(F.col("label"), F.col("to_final")).alias("name"))


@query("SELECT c_custkey id, CASE c_custkey % 4 WHEN 0 THEN 'CD ' || c_nationkey WHEN 1 THEN 'Norte, ' || c_nationkey WHEN 2 THEN '' ELSE 'El Campo - B' END venue FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 4 <> 3) UNION ALL SELECT c_custkey, 'El Campo' FROM customer WHERE c_custkey % 4 = 3")
def short_venues(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    venue = F.when(k % 4 == 0, F.concat(F.lit("Campo CD "), n, F.lit(" - Campo Uno"))).when(k % 4 == 1, F.concat(F.lit("Norte, "), n)).when(k % 4 == 3, "El Campo - B")
    return table(spark, sf_dir, "customer").select(k.alias("id"), text.short_venue(venue).alias("venue"))


@query(f"WITH {FIXTURES_SQL} SELECT DISTINCT season, grp, round, match_date, home, away, home_score, away_score FROM fixtures")
def html_match_rows(spark, sf_dir):
    """Fixtures written as a page of rounds and match rows, and read back from its HTML."""
    rows = fixtures(spark, sf_dir).select("season", "grp", "round", "match_date", "home", "away", "home_score", "away_score").distinct()
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("</td>"))
    line = F.concat(F.lit("<tr>"), cell("match_date"), F.lit("<td>10:00</td>"), cell("home"), cell("home_score"), cell("away_score"), cell("away"), F.lit("<td>Ground</td></tr>"))
    rounds = rows.groupBy("season", "grp", "round").agg(F.concat_ws("", F.array_sort(F.collect_list(line))).alias("body"))
    part = F.concat(F.lit('<tr><th colspan="7">'), F.col("round").cast("string"), F.lit("</th></tr>"), F.col("body"))
    pages = rounds.groupBy("season", "grp").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("round", part.alias("h")))), lambda x: x["h"])).alias("html"))
    pages = pages.select(F.struct("season", "grp").alias("page_id"), F.concat(F.lit("<table>"), "html", F.lit("</table>")).alias("html"))
    found = extract.rounds_and_matches(extract.table_rows(pages))
    return found.select("page_id.season", "page_id.grp", F.col("round").cast("int").alias("round"), F.col("date").cast("date").alias("match_date"), "home", "away", "home_score", "away_score")


@query("SELECT c_custkey, CASE WHEN n1 IS NOT NULL THEN n1 ELSE n2 END AS n_nationkey FROM (SELECT c_custkey, a.n_nationkey n1, b.n_nationkey n2 FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'Nation ' || c_nationkey || ' CF' ELSE 'Somewhere else' END nm FROM customer) LEFT JOIN nation a ON nm = a.n_name LEFT JOIN nation b ON nm = 'Nation ' || b.n_nationkey || ' CF')")
def badge_lookup(spark, sf_dir):
    """Names in three spellings looked up: as they are, by their key, or not at all."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    named = table(spark, sf_dir, "customer").select(k, F.when(k % 3 == 0, F.concat(F.lit("NATION_"), n)).when(k % 3 == 1, F.concat(F.lit("Nation "), n, F.lit(" CF"))).otherwise("Somewhere else").alias("name"))
    entries = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("value"))
    found = resolve.name_lookup(named.select("name").distinct(), entries, lambda name: text.team_key(F.translate(name, "_", " ")))
    return named.join(found, "name", "left").select("c_custkey", F.col("value").alias("n_nationkey"))


_LISTED = f"""w AS (SELECT s_suppkey k, translate(md5(CAST(s_suppkey % 40 AS VARCHAR)), '0123456789', 'ghijklmnop') a, translate(md5(CAST(s_suppkey AS VARCHAR)), '0123456789', 'ghijklmnop') b FROM supplier),
    en AS (SELECT k, (k * 7919) % 1009 pos, name, {_TEAM} AS key FROM (SELECT k, 'U.D. ' || left(a, 6) || ' ' || left(b, 8) AS name FROM w)),
    cu AS (SELECT c_custkey, translate(md5(CAST(c_custkey % 60 AS VARCHAR)), '0123456789', 'ghijklmnop') a, translate(md5(CAST(c_custkey % 300 AS VARCHAR)), '0123456789', 'ghijklmnop') b FROM customer),
    nc AS (SELECT c_custkey, name, {_TEAM} AS key FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN left(a, 6) WHEN 1 THEN 'Sur ' || left(a, 6) || ' ' || left(b, 8) || ' "B"' WHEN 2 THEN 'U.D. ' || left(a, 6) || ' ' || left(b, 8) WHEN 3 THEN left(a, 3) ELSE substr(a, 2, 5) END AS name FROM cu))"""


@query(
    f"""WITH {_LISTED}, h AS (SELECT nc.c_custkey, en.k, row_number() OVER (PARTITION BY nc.c_custkey ORDER BY CASE WHEN nc.name = en.name THEN 0 WHEN nc.key = en.key THEN 1 ELSE 2 END, en.pos, en.name) i
      FROM nc JOIN en ON nc.name = en.name OR (nc.key = en.key AND nc.key <> '') OR (length(nc.key) >= 4 AND length(en.key) >= 4 AND (contains(nc.key, en.key) OR contains(en.key, nc.key))))
    SELECT nc.c_custkey, h.k badge FROM nc LEFT JOIN h ON nc.c_custkey = h.c_custkey AND h.i = 1"""
)
def badge_substrings(spark, sf_dir):
    """Names looked up in a list: as they are, by key, else by the first entry of the list whose key holds theirs or is held."""
    letters = lambda c: F.translate(F.md5(c.cast("string").cast("binary")), "0123456789", "ghijklmnop")
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    full = lambda a, b: F.concat(F.substring(a, 1, 6), F.lit(" "), F.substring(b, 1, 8))
    entries = table(spark, sf_dir, "supplier").select(F.concat(F.lit("U.D. "), full(letters(s % 40), letters(s))).alias("name"), s.alias("value"), ((s * 7919) % 1009).alias("pos"))
    a, b = letters(k % 60), letters(k % 300)
    name = F.when(k % 5 == 0, F.substring(a, 1, 6)).when(k % 5 == 1, F.concat(F.lit("Sur "), full(a, b), F.lit(' "B"'))).when(k % 5 == 2, F.concat(F.lit("U.D. "), full(a, b))).when(k % 5 == 3, F.substring(a, 1, 3)).otherwise(F.substring(a, 2, 5))
    named = table(spark, sf_dir, "customer").select(k, name.alias("name"))
    found = resolve.name_lookup(named.select("name").distinct(), entries, text.team_key, order="pos")
    return named.join(found, "name", "left").select("c_custkey", F.col("value").alias("badge"))


@query(
    """WITH g AS (SELECT c_custkey id, c_custkey % 9 k, c_custkey % 7 n FROM customer)
    SELECT id, CASE k WHEN 0 THEN 'Benjamin Segunda Fase ' || chr(CAST(65 + n AS INT)) || '-G' || n WHEN 1 THEN 'BENJAMIN PRIMERA LANZAROTE G' || n WHEN 2 THEN 'BENJAMIN FUERTEVENTURA LIGA ORO' WHEN 3 THEN 'Benjamin Fuerteventura Liga Plata'
      WHEN 4 THEN 'BENJAMIN FUERTEVENTURA LIGA BRONCE' WHEN 5 THEN 'PREBENJAMIN GC GRUPO ' || n WHEN 6 THEN 'BENJAMIN FUERTEVENTURA' WHEN 7 THEN 'BENJAMIN LANZAROTE ORO' END AS name,
    CASE k WHEN 0 THEN CASE WHEN n < 3 THEN chr(CAST(65 + n AS INT)) || n END WHEN 1 THEN 'LZ' || n WHEN 2 THEN 'FO' WHEN 3 THEN 'FP' WHEN 4 THEN 'FB' WHEN 5 THEN 'PG' || n END code FROM g"""
)
def group_codes(spark, sf_dir):
    """Codes of groups from their names in scorer lists."""
    k, n = F.col("c_custkey") % 9, F.col("c_custkey") % 7
    numbered = lambda start: F.concat(F.lit(start), n.cast("string"))
    name = F.when(k == 0, F.concat(F.lit("Benjamin Segunda Fase "), F.chr(65 + n), numbered("-G"))).when(k == 1, numbered("BENJAMIN PRIMERA LANZAROTE G")).when(k == 2, "BENJAMIN FUERTEVENTURA LIGA ORO").when(k == 3, "Benjamin Fuerteventura Liga Plata")
    name = name.when(k == 4, "BENJAMIN FUERTEVENTURA LIGA BRONCE").when(k == 5, numbered("PREBENJAMIN GC GRUPO ")).when(k == 6, "BENJAMIN FUERTEVENTURA").when(k == 7, "BENJAMIN LANZAROTE ORO")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"))
    return rows.select("id", "name", text.scorer_group_code(F.col("name")).alias("code"))


@query(
    r"""WITH s AS (SELECT c_custkey id, 2021 + c_custkey % 4 season, CASE c_custkey % 3 WHEN 0 THEN 'benjamin' WHEN 1 THEN 'benjamin_prefe' ELSE 'prebenjamin' END category, c_custkey % 20 n, CASE WHEN c_custkey % 11 = 0 THEN '2segunda' WHEN c_custkey % 13 = 0 THEN '1lanzarote' ELSE
      CASE c_custkey % 3 WHEN 0 THEN '1benjamin' WHEN 1 THEN '1benjamin-prefe' ELSE '1prebenjamin' END END || (c_custkey % 20) slug, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Grupo' ELSE 'Grupo ' || (c_custkey % 20) || ' Fase ' || chr(CAST(65 + c_custkey % 7 AS INT)) END group_name, CASE WHEN c_custkey % 5 > 0 THEN 'Q' END prefix FROM customer)
    SELECT id, season, slug, CASE WHEN slug LIKE '1benjamin-prefe%' AND season < 2023 THEN 'BPGC' || n WHEN slug LIKE '1benjamin%' AND slug NOT LIKE '%-%' THEN CASE WHEN season < 2024 THEN 'GC' ELSE 'P' END || n WHEN slug LIKE '1prebenjamin%' THEN 'PGC' || n ELSE upper(slug) END code,
    CASE WHEN season < 2023 THEN CASE WHEN category = 'benjamin_prefe' THEN 'Preferente GC' ELSE 'Primera Fase GC' END WHEN season = 2023 THEN CASE WHEN slug LIKE '%lanzarote%' THEN 'Lanzarote' WHEN slug LIKE '2%' THEN 'Segunda Fase GC' ELSE 'Primera Fase GC' END
      WHEN category = 'prebenjamin' THEN 'Gran Canaria' ELSE 'Primera Fase GC' END phase,
    coalesce(prefix, 'X') || CASE WHEN group_name LIKE '% %' THEN n::VARCHAR ELSE '1' END competition,
    CASE WHEN category = 'benjamin' THEN 'BC' || CASE WHEN id % 7 IN (2, 3, 4) THEN chr(CAST(65 + id % 7 AS INT)) ELSE '' END || '1' ELSE 'PCC1' END cup FROM s"""
)
def season_slugs(spark, sf_dir):
    """Codes and phases by the rules of each season, codes of competitions and of knock-outs."""
    k, n = F.col("c_custkey"), (F.col("c_custkey") % 20).cast("string")
    by = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    slug = F.concat(F.when(k % 11 == 0, "2segunda").when(k % 13 == 0, "1lanzarote").otherwise(by("1benjamin", "1benjamin-prefe", "1prebenjamin")), n)
    group = F.when(k % 7 == 1, "Grupo").when(k % 7 > 1, F.concat(F.lit("Grupo "), n, F.lit(" Fase "), F.chr(65 + k % 7)))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 4 + 2021).alias("season"), by("benjamin", "benjamin_prefe", "prebenjamin").alias("category"), slug.alias("slug"), group.alias("group_name"), F.when(k % 5 > 0, "Q").alias("prefix"))
    c = F.col
    return rows.select(
        "id", "season", "slug", text.season_slug_code(c("slug"), c("season")).alias("code"), text.season_phase(c("slug"), c("category"), c("season")).alias("phase"), text.competition_code(c("prefix"), c("group_name")).alias("competition"),
        text.cup_code(c("category"), c("group_name")).alias("cup"),
    )


@query(
    """WITH c AS (SELECT c_nationkey + 25 * (c_custkey // 1000) grp, c_custkey k, c_nationkey % 5 n FROM customer),
    x AS (SELECT grp, min(n) n, count(*) n_stored, count(*) FILTER (WHERE n = 4 OR n = 2 AND k % 3 = 0 OR n = 3 AND k % 3 <> 0) matched FROM c GROUP BY grp)
    SELECT grp, CASE WHEN n > 0 THEN n_stored ELSE 0 END n_page, n_stored, CASE WHEN n > 0 THEN matched / n_stored END overlap, CASE WHEN n = 0 THEN 'no table' WHEN 2 * matched >= n_stored THEN 'same' ELSE 'other' END state FROM x"""
)
def same_leagues(spark, sf_dir):
    """Groups whose page shows the stored league under other spellings, half of it, another one or nothing."""
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 5
    word = lambda x: F.translate(F.reverse(F.lpad(x.cast("string"), 8, "0")), "0123456789", "ghijklmnop")
    rows = table(spark, sf_dir, "customer").withColumn("grp", (F.col("c_nationkey") + 25 * F.floor(k / 1000)).cast("long"))
    moved = (n == 1) | ((n == 2) & (k % 3 != 0)) | ((n == 3) & (k % 3 == 0))
    page = rows.where(n > 0).select("grp", F.concat(F.lit("C.D. "), word(F.when(moved, k + 5_000_000).otherwise(k))).alias("name"))
    stored = rows.select("grp", F.concat(F.initcap(word(k)), F.lit(", C.F.")).alias("name"))
    return resolve.same_league(page, stored, ("grp",))
