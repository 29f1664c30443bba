"""Rows from HTML, with regular expressions that Catalyst runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.arrays import let
from tallyfield.functions.html import stripped
from tallyfield.functions.text import squeezed


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"<title>([^<]*)</title>", 1)
    return F.when(found != "", found)


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Each page's distinct link targets."""
    return pages.select(key, F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


def discovered(pages: DataFrame, pattern: str) -> DataFrame:
    """Distinct link targets that fit a pattern, with the number of pages that have them."""
    return links(pages).where(F.col("href").rlike(pattern)).groupBy("href").agg(F.count("*").alias("pages"))


def numbered(prefix: str, first: int, last: int, spark) -> DataFrame:
    """Candidate slugs prefix1 .. prefixN."""
    return spark.range(first, last + 1).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("slug"))


def blocks(pages: DataFrame, tag: str, key: str = "page_id") -> DataFrame:
    """The contents of a tag's elements, in order."""
    found = F.regexp_extract_all("html", F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "content"))


def table_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The rows of all tables in order, each with its cells' texts."""
    rows = blocks(pages, "tr", key)
    cells = F.transform(F.regexp_extract_all("content", F.lit(r"(?s)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), stripped)
    return rows.select(key, "pos", cells.alias("cells"))


def rounds_and_matches(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Match rows with the round that the last one-cell row before them named.

    Seven cells: date, time, home, home score, away score, away, venue.  Other rows are left out.
    """
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n, cell = F.size("cells"), lambda i: F.get("cells", F.lit(i))
    rows = rows.withColumn("round", F.last(F.when(n == 1, cell(0)), ignorenulls=True).over(order))
    return rows.where(n == 7).select(
        key, "pos", "round", cell(0).alias("date"), cell(1).alias("time"), cell(2).alias("home"), cell(3).try_cast("int").alias("home_score"), cell(4).try_cast("int").alias("away_score"), cell(5).alias("away"), cell(6).alias("venue")
    )


def calendar_rows(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """round, date, home, away and scores from the match rows of archived calendars in two layouts.

    Seven cells: date, time, home, home score, away score, away, venue, in the round of the last one-cell row ``JORNADA n``.
    Nine cells: round, check mark, date, time, venue, home, home score, away score, away.  A date is the year and the first
    two short numbers, day and month, of its cell.  Rows without a round, a date or a team are left out; a score counts
    only if both are numbers.
    """
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n, cell = F.size("cells"), lambda i: F.trim(F.get("cells", F.lit(i)))
    at = lambda seven, nine: F.when(n == 7, cell(seven)).otherwise(cell(nine))
    number = lambda c: F.when(c.rlike(r"^[0-9]+$"), c.try_cast("int"))
    named = F.nullif(F.regexp_extract(F.when(n == 1, cell(0)), r"(?i)^JORNADA\s+(\d+)", 1), F.lit(""))
    rows = rows.withColumn("named", F.last(named, ignorenulls=True).over(order)).where(n.isin(7, 9))
    rows = rows.select(
        key, "pos", F.when(n == 7, F.col("named")).otherwise(F.nullif(F.regexp_extract(cell(0), r"^\d+", 0), F.lit(""))).alias("round"), F.regexp_extract_all(at(0, 2), F.lit(r"\d+"), F.lit(0)).alias("numbers"),
        at(2, 5).alias("home"), number(at(3, 6)).alias("h"), number(at(4, 7)).alias("a"), at(5, 8).alias("away"),
    )
    year = F.get(F.filter("numbers", lambda x: (F.length(x) == 4) & x.between("2020", "2030")), F.lit(0))
    short = F.transform(F.filter("numbers", lambda x: F.length(x) <= 2), lambda x: F.lpad(x, 2, "0"))
    both = F.col("h").isNotNull() & F.col("a").isNotNull()
    found = rows.withColumns({"year": year, "short": short}).where("round is not null and year is not null and size(short) > 1 and home <> '' and away <> ''")
    day = F.concat_ws("-", "year", F.get("short", F.lit(1)), F.get("short", F.lit(0)))
    return found.select(key, "pos", "round", day.alias("date"), "home", F.when(both, F.col("h")).alias("home_score"), F.when(both, F.col("a")).alias("away_score"), "away")


def standings_rows(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Table rows of four layouts by the number of cells: 17 and 16 with home and away parts, 11 and 10 with totals."""
    n = F.size("cells")
    cell = lambda i: F.get("cells", i).try_cast("int")
    off = F.when(n.isin(17, 11), 1).otherwise(0)
    total = lambda k: F.when(n.isin(16, 17), F.coalesce(cell(off + 2 + k), F.lit(0)) + F.coalesce(cell(off + 8 + k), F.lit(0))).otherwise(cell(off + 2 + k))
    names = ("played", "won", "drawn", "lost", "gf", "ga")
    return rows.where(n.isin(10, 11, 16, 17)).select(key, "pos", F.get("cells", off).alias("team"), F.get("cells", off + 1).try_cast("int").alias("points"), *[total(k).cast("int").alias(c) for k, c in enumerate(names)])


def consistent(rows: DataFrame, least: float = 0.8, key: str = "page_id") -> DataFrame:
    """Rows of pages where at least a share of rows adds up: played = won + drawn + lost."""
    ok = F.coalesce(F.col("played") == F.col("won") + F.col("drawn") + F.col("lost"), F.lit(False))
    return rows.withColumn("share", F.avg(ok.cast("int")).over(Window.partitionBy(key))).where(F.col("share") >= least).drop("share")


def first_matches(matches: DataFrame, key: str = "page_id") -> DataFrame:
    """The first row of each (home, away) of a page."""
    return matches.withColumn("n", F.row_number().over(Window.partitionBy(key, "home", "away").orderBy("pos"))).where("n = 1").drop("n")


# The blocks of a page's goals, home before away, and a goal in them.
GOAL_BLOCK = r"(?is)<div[^>]+grupo-negro12[^>]*>(.*?)</div>"
GOAL_LINE = r"(\d+)[´'`]\s*-\s*([^\n<\r]+)"


def goal_lines(pages: DataFrame, key: str = "match_id") -> DataFrame:
    """key, n, minute, player, side of the goals on pages of (key, html), in order of minutes.

    The first block holds the home side's goals, the second the away side's; goals of one minute keep the order of
    the page, home before away.  Lines without a minute or a name are none.
    """
    found = F.regexp_extract_all("html", F.lit(GOAL_BLOCK), F.lit(1))
    goal = lambda m, side: F.struct(F.regexp_extract(m, GOAL_LINE, 1).try_cast("int").alias("minute"), F.lit(side).alias("side"), F.trim(F.regexp_extract(m, GOAL_LINE, 2), F.lit(" \t")).alias("player"))
    of = lambda i, side: F.transform(F.regexp_extract_all(F.coalesce(F.get(found, F.lit(i)), F.lit("")), F.lit(GOAL_LINE), F.lit(0)), lambda m: goal(m, side))
    named = F.filter(F.concat(of(0, "h"), of(1, "a")), lambda g: (g["player"] != "") & g["minute"].isNotNull())
    keyed = F.sort_array(F.transform(named, lambda g, i: F.struct(g["minute"].alias("minute"), i.alias("i"), g["player"].alias("player"), g["side"].alias("side"))))
    return pages.select(key, F.posexplode(keyed).alias("n", "g")).select(key, (F.col("n") + 1).alias("n"), "g.minute", "g.player", "g.side")


def sided_events(events: DataFrame, lineups: DataFrame) -> DataFrame:
    """Events (match_id, player) with the side whose line-up has the player; unknown players' events go."""
    who = lineups.select("match_id", F.upper(squeezed(F.col("name"))).alias("k"), "side").groupBy("match_id", "k").agg(F.min("side").alias("side"))
    return events.withColumn("k", F.upper(squeezed(F.col("player")))).join(who, ["match_id", "k"]).drop("k")


# The digits that calls ntype("id", n, i, "class") stand for, by row i and place n.
CALLED_DIGITS = (
    (2, 5, 9, 4, 1, 0, 8, 6, 3, 7),
    (1, 3, 5, 7, 9, 0, 2, 4, 6, 8),
    (0, 2, 4, 6, 8, 1, 3, 5, 7, 9),
    (7, 5, 2, 0, 9, 6, 3, 8, 4, 1),
)
# Score cells, and the ways in which one shows its number.
SCORE_CELL = r'(?s)<span\s+class="wid2_resultado_cerrada[^"]*"[^>]*>(.*?)</span>\s*(?=<span\s+class="wid2_resultado_cerrada|</strong>)'
CELL_CALL = r'ntype\("[^"]*",\s*(\d+),\s*(\d+)\s*,'
HIDDEN_DIGITS, PLAIN_DIGITS, STYLE_DIGITS = r'<span\s+style="display:\s*none;?"\s*>(\d+)</span>', r'<i class="fa-solid">\s*(\d+)\s*</i>', r':before\s*\{[^}]*content:\s*"(\d+)"'
NOT_DIGITS, LONE_DIGIT = r'(?:ntype\([^)]*\))|(?:fa-\d)|(?:idh\d+)|(?:id="[^"]*")', r"(?<![\w-])(\d)(?![\w-])"


def cell_score(html: Column) -> Column:
    """struct<home, away> of a score's cells, each read by the first way that applies to it.

    Calls come first and decide alone: their digits joined, those beyond the table left out.  Then a hidden number,
    a plain one, one in a style rule, and last the first digit that stands alone.
    """
    table = F.array(*[F.lit(str(d)) for row in CALLED_DIGITS for d in row])

    def called(cell: Column) -> Column:
        place = lambda c: F.regexp_extract(c, CELL_CALL, 2).cast("int") * 10 + F.regexp_extract(c, CELL_CALL, 1).cast("int")
        return F.transform(F.regexp_extract_all(cell, F.lit(CELL_CALL), F.lit(0)), lambda c: F.get(table, place(c)))

    def number(cell: Column) -> Column:
        ways = [F.regexp_extract(cell, p, 1).try_cast("int") for p in (HIDDEN_DIGITS, PLAIN_DIGITS, STYLE_DIGITS)]
        last = F.regexp_extract(F.regexp_replace(cell, NOT_DIGITS, ""), LONE_DIGIT, 1).try_cast("int")
        return let(called(cell), lambda c: F.when(F.size(c) > 0, F.array_join(c, "").try_cast("int")).otherwise(F.coalesce(*ways, last)))

    cells = F.transform(F.regexp_extract_all(html, F.lit(SCORE_CELL), F.lit(1)), number)
    return let(cells, lambda n: F.struct(F.get(n, F.lit(0)).alias("home"), F.get(n, F.lit(1)).alias("away")))


# Names, points and figures of a table in its newer and its older layout.
NEW_NAME, NEW_POINTS, NEW_ROW, NEW_FIGURE = r"fw-bolderr[^>]*>\s*([^<]+?)\s*<", r"text-warning-emphasis[^>]*>\s*(\d+)", "contenedor__item", r"borderr-start[^>]*>\s*(-?\d+)\s*<"
OLD_NAME, OLD_POINTS, OLD_FIGURE = r"fw-bolder[^>]*>([^<]+)", r'fw-bold[^"]*bg-[^"]*"[^>]*>\s*(\d+)\s*<', r'border-start[^"]*"[^>]*>\s*(-?\d+)\s*<'
FIGURES = ("played", "won", "drawn", "lost", "gf", "ga", "gd")


def _table_row(i: Column, names: Column, points: Column, figures) -> Column:
    return F.struct((i + 1).cast("int").alias("pos"), F.get(names, i).alias("team"), F.get(points, i).try_cast("int").alias("points"), *[F.get(figures(i), F.lit(k)).try_cast("int").alias(c) for k, c in enumerate(FIGURES)])


def new_layout(html: Column) -> Column:
    """Rows of the newer layout: figures stand in boxes of their own.  Null unless there are points for all names and
    four of five rows add up: played = won + drawn + lost."""
    every = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    boxes = F.transform(F.slice(F.split(html, NEW_ROW), F.lit(2), F.size(F.split(html, NEW_ROW))), lambda b: F.slice(every(b, NEW_FIGURE), 1, 7))
    parts = F.struct(every(html, NEW_NAME).alias("names"), every(html, NEW_POINTS).alias("points"), F.filter(boxes, lambda b: F.size(b) == 7).alias("boxes"))

    def rows(p: Column) -> Column:
        n = F.least(F.size(p["names"]), F.size(p["boxes"]))
        built = F.when((n > 0) & (F.size(p["points"]) >= n), F.transform(F.sequence(F.lit(0), n - 1), lambda i: _table_row(i, p["names"], p["points"], lambda j: F.get(p["boxes"], j))))
        right = lambda b: F.size(F.filter(b, lambda r: r["played"] == r["won"] + r["drawn"] + r["lost"]))
        return let(built, lambda b: F.when(right(b) >= 0.8 * F.size(b), b))

    return let(parts, rows)


def old_layout(html: Column) -> Column:
    """Rows of the older layout: seven figures a team, one after another.  Null if there are fewer."""
    every = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    names = F.filter(F.transform(every(OLD_NAME), lambda n: F.trim(n)), lambda n: n != "")
    parts = F.struct(names.alias("names"), every(OLD_POINTS).alias("points"), every(OLD_FIGURE).alias("figures"))

    def rows(p: Column) -> Column:
        teams = F.size(p["points"])
        n = F.least(teams, F.size(p["names"]))
        return F.when((n > 0) & (F.size(p["figures"]) >= 7 * teams), F.transform(F.sequence(F.lit(0), n - 1), lambda i: _table_row(i, p["names"], p["points"], lambda j: F.slice(p["figures"], j * 7 + 1, F.lit(7)))))

    return let(parts, rows)


def standings_by_layout(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, layout and rows of the tables on pages of (key, html): the newer layout where it holds, else the older one."""
    both = let(F.struct(new_layout(F.col("html")).alias("new"), old_layout(F.col("html")).alias("old")), lambda t: F.struct(F.when(t["new"].isNotNull(), "new").when(t["old"].isNotNull(), "old").alias("layout"), F.coalesce(t["new"], t["old"]).alias("rows")))
    return pages.select(key, both.alias("t")).select(key, "t.layout", F.explode("t.rows").alias("r")).select(key, "layout", "r.*")


def is_empty_report(header: str = "header", home: str = "lineups.home", away: str = "lineups.away") -> Column:
    """A report whose header fields are all null and that has no line-ups."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return F.coalesce(F.to_json(header), F.lit("{}")).eqNullSafe("{}") & none(home) & none(away)


# Where report pages hold their parts.
CALL = r'ntype\("[^"]+",\s*(\d+),\s*(\d+),\s*"[^"]+"\)'
SCORE_BLOCK, SCORE_DASH = r'(?is)<h2\s+class="ntype">(.*?)</h2>', " - "
FICHA = r'(?is)class="font-grey-cascade">Temporada\s+(\d{4}-\d{4})[^<]*Jornada\s+(\d+).*?(\d{2}-\d{2}-\d{4})'
TROPHY, TEAM_BOX = r"(?i)fa-trophy[^>]*></i>\s*([^<]+)", r'class="font_widget{}">([^<]+)</div>'
REFEREE = r"(?i)<strong>[AÁ]rbitro/a\s+Principal</strong>(?:&nbsp;|\s)+([^<]+)"
COACH, ABSENT = r"(?i)<strong>Entrenador:\s*</strong>\s*([^<\n\r]+)", r"(?i)no\s+presenta"
SCORER = r"(?s)data-bs-title=[\"']<div [^>]*>([^<]+)<br>.*?data-bs-content=[\"']<b>\s*([^<]+?)\s*</b>.*?</button>\s*</div>\s*<div [^>]*btn btn-outline-primary[^>]*>\s*(\d+).*?<div class=\"btn active btn-primary[^>]*>(\d+)"
CALENDAR = r"calendarioClasificacion\('([^']+)'"
BADGE = r'(?i)<img\s+src="[^"]*escudos/([^"]+\.(?:png|jpg|gif|svg))"[^>]*title="\s*Calendario\s+([^"]*)"'
TEAM_CODE = r"(?i)<td[^>]*fw-bold[^>]*>\s*([A-Za-zà-ÿ '.,]+?)\s*<a\s+href=\"[^\"]*?-([A-Z0-9]+)\.html\""


def _found(html: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(html, pattern, group), F.lit(""))


def called_digits(html: Column) -> Column:
    """The digits of all calls in order, as text; a place beyond the table is 0."""
    table = F.array(*[F.lit(str(d)) for row in CALLED_DIGITS for d in row])
    place = lambda c: (F.regexp_extract(c, CALL, 2).cast("int") * 10 + F.regexp_extract(c, CALL, 1).cast("int"))
    return F.concat_ws("", F.transform(F.regexp_extract_all(html, F.lit(CALL), F.lit(0)), lambda c: F.coalesce(F.get(table, place(c)), F.lit("0"))))


def visible_digits(html: Column) -> Column:
    """The digits that a reader sees: none of hidden spans, of styles or of tags."""
    shown = html
    for pattern in (r"(?is)<span[^>]*display\s*:\s*none[^>]*>.*?</span>", r"(?is)<style[^>]*>.*?</style>", r"<[^>]+>"):
        shown = F.regexp_replace(shown, pattern, " ")
    return F.regexp_replace(shown, r"[^0-9]", "")


def report_score(html: Column) -> Column:
    """struct<home, away> of a report's score: digits of calls, else visible ones; null where there are none.

    The block is cut out once, and what is visible is looked for only where there are no calls.
    """
    digits = lambda part: let(called_digits(part), lambda d: F.when(d != "", d).otherwise(F.nullif(visible_digits(part), F.lit(""))).try_cast("int"))
    sides = lambda block: F.when(F.instr(block, SCORE_DASH) > 0, F.transform(F.split(block, SCORE_DASH, 2), digits))
    both = lambda n: F.struct(F.get(n, F.lit(0)).alias("home"), F.get(n, F.lit(1)).alias("away"))
    return let(F.regexp_extract(html, SCORE_BLOCK, 1), lambda block: let(sides(block), both))


def _text(found: Column) -> Column:
    """Text without tags of what was found, worked out once; null for null."""
    return let(found, stripped)


def report_header(html: Column) -> Column:
    """struct of season, round, date, teams, scores and competition of a report's page; what is missing is null."""

    def fields(ficha: Column, score: Column) -> Column:
        return F.struct(
            F.replace(_found(ficha, FICHA, 1), F.lit("-"), F.lit("/")).alias("season"),
            _found(ficha, FICHA, 2).alias("round"),
            _found(ficha, FICHA, 3).alias("date"),
            _text(_found(html, TEAM_BOX.format("L"))).alias("home_team"),
            _text(_found(html, TEAM_BOX.format("V"))).alias("away_team"),
            score["home"].alias("home_score"),
            score["away"].alias("away_score"),
            _text(_found(html, TROPHY)).alias("competition"),
        )

    return let(F.regexp_extract(html, FICHA, 0), lambda ficha: let(report_score(html), lambda score: fields(ficha, score)))


def report_staff(html: Column) -> Column:
    """struct<referee, coach_home, coach_away>; a coach who is named as absent is null."""
    named = lambda c: let(stripped(c), lambda name: F.when(~name.rlike(ABSENT), name))
    coaches = F.transform(F.regexp_extract_all(html, F.lit(COACH), F.lit(1)), named)
    both = lambda c: F.struct(_text(_found(html, REFEREE)).alias("referee"), F.get(c, F.lit(0)).alias("coach_home"), F.get(c, F.lit(1)).alias("coach_away"))
    return let(coaches, both)


def form_keys(html: Column) -> Column:
    """struct<calendar, table>: what the forms behind a table page ask for; null where the page names no calendar."""
    return let(_found(html, CALENDAR), lambda c: F.when(c.isNotNull(), F.struct(c.alias("calendar"), F.replace(c, F.lit("calendario_"), F.lit("clasi_")).alias("table"))))


def _matches(pages: DataFrame, pattern: str, names: tuple[str, ...], key: str) -> DataFrame:
    """The groups of every match of a pattern, in order."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("pos", "m"))
    return found.select(key, "pos", *[squeezed(F.regexp_extract("m", pattern, i)).alias(n) for i, n in enumerate(names, 1)])


def scorer_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """player, team, played and goals of a page's scorers."""
    rows = _matches(pages, SCORER, ("team", "player", "played", "goals"), key)
    return rows.withColumns({c: F.col(c).try_cast("int") for c in ("played", "goals")}).where("player <> '' and team <> '' and goals >= 0")


def badges(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """team and badge file of a page's calendar images, sizes before the name dropped; of several the last."""
    rows = _matches(pages, BADGE, ("file", "team"), key).where("team <> ''").withColumn("file", F.regexp_replace("file", r"^\d+x\d+", ""))
    return rows.groupBy(key, "team").agg(F.max_by("file", "pos").alias("file"))


def team_codes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """team and code of a page's links; a code belongs to the first team that has it."""
    rows = _matches(pages, TEAM_CODE, ("team", "code"), key).where("team <> ''")
    return rows.groupBy(key, "code").agg(F.min_by("team", "pos").alias("team")).select(key, "team", "code")
