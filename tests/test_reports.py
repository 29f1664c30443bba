"""Report pages in the layout they are served in, with invented names; every rule by a page of its own."""

import pytest

from pyspark.sql import functions as F
from tallyfield.functions import text
from tallyfield.functions.html import stripped, unescaped
from tallyfield.operators import extract, reports

PANEL = '<div class="number" x>{}</div><h5><strong>Titulares</strong></h5>{}{}</div></div> </div>\n</div>'
ROW = "<tr><td> {} </td>\n<td class=a> {} </td></tr>"
SUBS = '<h5 class="z"><strong>Suplentes</strong></h5>'
HOME = PANEL.format("CLUB UNO", ROW.format(7, "P&Eacute;REZ, ANA") + ROW.format(8, "AB"), SUBS + ROW.format(9, "LOPEZ, EVA"))
AWAY = PANEL.format("CLUB DOS", ROW.format(1, "RUIZ, SOL"), "")


def one(spark, expression, value="x"):
    return spark.createDataFrame([(value,)], "html string").select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "html,expected",
    [
        ("Gu&iacute;a &#225; Mu&ntilde;oz &#xE9;", "Guía á Muñoz é"),
        ("a &amp;lt; b &amp;&amp; c", "a &lt; b && c"),
        ("&nope; & &; &#; x&y", "&nope; & &; &#; x&y"),
        ("&#150;&#0;&#xD800;&#1114112;&#x1F600;", "–\ufffd\ufffd\ufffd😀"),
        ("", ""),
        (None, None),
    ],
)
def test_entities(spark, html, expected):
    assert one(spark, unescaped(F.col("html")), html) == expected


def test_tags_and_spaces_that_do_not_break(spark):
    assert one(spark, stripped(F.col("html")), "<b>A</b>&nbsp;&nbsp; B\n<i> C") == "A B C"


def players(spark, html):
    found = one(spark, reports.line_ups(F.col("html")), html)
    return {side: [tuple(p) for p in found[side]] for side in ("home", "away")}


def test_line_ups(spark):
    other = '<div class="number">Árbitros</div><strong>Titulares</strong><td>1</td><td>NO, NO</td><div class="number">Goles</div>Titulares<div class="number">CLUB</div><td>2</td><td>NO, NO</td>'
    expected = {"home": [(7, "PÉREZ, ANA", "starter"), (9, "LOPEZ, EVA", "sub")], "away": [(1, "RUIZ, SOL", "starter")]}
    assert players(spark, HOME + other + AWAY + ROW.format(3, "OUT, SIDE")) == expected
    assert players(spark, (HOME + AWAY).replace("Titulares", "TITULARES").replace("<div", "<DIV")) == expected
    assert players(spark, HOME) == {**expected, "away": []}
    assert players(spark, "") == {"home": [], "away": []} == players(spark, '<div class="number">')


def test_tags_within_tags_and_entities_that_do_not_end(spark):
    odd = HOME.replace("CLUB UNO", "Goles").replace(" x>", " </x>") + HOME.replace("<td class=a>", "<td a='<b'>").replace(" 7 ", "\u00a07 ")
    assert players(spark, odd) == {"home": [(7, "PÉREZ, ANA", "starter"), (9, "LOPEZ, EVA", "sub")], "away": []}
    assert one(spark, unescaped(F.col("html")), "&#65\n;&#65;") == "&#65\n;A"


def test_a_last_panel_that_does_not_close_is_none(spark):
    assert players(spark, HOME + AWAY.split("</div></div>")[0])["away"] == []
    assert len(players(spark, HOME + AWAY.split("</div></div>")[0] + '<div class="number">')["away"]) == 1


def events(spark, html):
    lines = reports.line_ups(F.col("html"))
    return [tuple(e) for e in one(spark, reports.events(F.col("html"), lines), html)]


GOAL = '<tr><td><i class="img  lgol" {}></i></td><td class="font_responsive">(<span class="y {}" id="{}">x</span> {} </td></tr>'


def test_goals(spark):
    style = "<style>#m1::before { content: \"\\0030\" } .k7:after{color:red; content:'12'} .m2:before{content:\"99\"}</style><STYLE type=a>.k8::after{content:\"5\"}\n.k8:before{content:\"6\"}</STYLE>"
    body = "<div>Goles</div>" + GOAL.format('title="Gol Penalti"', "k7", "m1", "pérez, ana") + GOAL.format('title=" Gol Propia Puerta "', "k7", "q", "RUIZ, SOL") + GOAL.format("", "k8", "q", "LOPEZ, EVA") + GOAL.format('title="?"', "", "", "RUIZ, SOL")
    wrong = GOAL.format("", "", "", "NADIE, NUNCA") + GOAL.format("", "", "", "SIN COMA") + GOAL.format("", "", "", "RUIZ, SOL").replace("lgol", "gol")
    assert events(spark, style + HOME + AWAY + body + wrong) == [
        ("goal", "home", "LOPEZ, EVA", 6, "normal", None),
        ("goal", "away", "RUIZ, SOL", 12, "own", None),
        ("goal", "home", "pérez, ana", 30, "penalty", None),
        ("goal", "away", "RUIZ, SOL", None, "normal", None),
    ]


def test_a_section_ends_after_its_length(spark):
    far = "<div>Goles</div>" + " " * reports.GOALS_LENGTH + GOAL.format("", "", "", "RUIZ, SOL")
    assert events(spark, HOME + AWAY + far) == []


def sections(spark, html):
    return [list(rows) for rows in one(spark, reports.section_rows(F.col("html")), html)]


def test_sections_are_cut_alike_at_once_and_each_by_itself(spark):
    """Far headings, pages that go on beyond a section's length, and rows that hold a heading give the same rows."""
    page = "<tr>x</tr><div>Goles</div><tr>a</tr><TR b>c</TR><div>Cambios</div><tr>d<td></tr>tarjetas</div><tr e>f</tr><tr"
    expected = [["a", "c", "d<td>", "f"], ["d<td>", "f"], ["f"]]
    far, long = " " * reports.OTHER_LENGTH + page, page + " " * reports.OTHER_LENGTH
    assert sections(spark, page) == sections(spark, far) == sections(spark, long) == expected
    held = "<div>Goles</div><tr>a<div>Cambios</div><td></tr><tr>b</tr><tr Tarjetas</div><tr>c</tr>"
    assert sections(spark, held) == [["a<div>Cambios</div><td>", "b", "<tr>c"], ["b", "<tr>c"], ["c"]]
    assert sections(spark, "") == [[], [], []]


def test_substitutions_and_cards(spark):
    swaps = "<div>Sustituciones</div><tr>(1) PÉREZ, ANA (2) LOPEZ, EVA</tr><tr>(1) NADIE, NO (2) NUNCA, NO</tr><tr>(1) RUIZ, SOL</tr><tr id='m'>(1) NADIE, NO (2) ruiz, sol</tr>"
    shown = "<div>Amonestaciones</div><tr><td>RUIZ, SOL</td><td>1 Tarjeta ROJA</td></tr><tr>PÉREZ, ANA</tr><tr>NADIE, NO</tr>"
    assert events(spark, "<style>#m:before{content:'4'}</style>" + HOME + AWAY + swaps + shown) == [
        ("red", "away", "RUIZ, SOL", None, None, None),
        ("sub_in", "home", "LOPEZ, EVA", None, None, 0),
        ("sub_in", "away", "ruiz, sol", None, None, 1),
        ("sub_out", "home", "PÉREZ, ANA", None, None, 0),
        ("sub_out", "away", "NADIE, NO", None, None, 1),
        ("yellow", "home", "PÉREZ, ANA", None, None, None),
    ]


def test_pages_without_anything(spark):
    pages = spark.createDataFrame([(1, ""), (2, None), (3, "<p>")], "report_id int, html string")
    assert {r["report_id"]: r["events"] for r in reports.parsed_reports(pages).collect()} == {1: [], 2: None, 3: []}


def test_goal_lines_as_served(spark):
    page = "<div class='grupo-negro12'>12´ -  Ana Sur<br />13' - \tEva<br />40´ - <br />x - No</div><div>7´ - No</div><div class=\"a grupo-negro12\">13` - Sol\r\n5´-Luz</div>"
    pages = spark.createDataFrame([(1, page), (2, "<p>"), (3, None)], "match_id int, html string")
    assert [tuple(r) for r in extract.goal_lines(pages).orderBy("match_id", "n").collect()] == [(1, 1, 5, "Luz", "a"), (1, 2, 12, "Ana Sur", "h"), (1, 3, 13, "Eva", "h"), (1, 4, 13, "Sol", "a")]


@pytest.mark.parametrize("name,hue", [("Norte Mar", 336), ("", 0), ("A", 65)])
def test_hue(spark, name, hue):
    assert one(spark, text.name_hue(F.col("html")), name) == hue


@pytest.mark.parametrize("phase,sign", [("Segunda Fase B", "🥈"), ("Primera Fase GC", "🏟️"), ("Fase GC", "🏔️"), ("Copa Lanzarote", "🏆"), (None, "⚽")])
def test_signs(spark, phase, sign):
    assert one(spark, text.phase_sign(F.col("html")), phase) == sign


def test_calendar_rows_in_both_layouts(spark):
    """Rows before any round, without a date, a round or a team go; a score needs both numbers."""
    nine = lambda turn, day, h, a, away="B": [turn, "x", day, "10:00", "Campo", "A", h, a, away]
    cells = [
        ["Sab 4/3/2023", "", "A", "1", "2", "B", "Campo"], ["JORNADA 7"], ["Equipos"], ["Sab 4/3/2023", "", "A", " 1", "2", "B", "Campo"], nine("3 (ida)", "12-10-2024", "2", "0"),
        nine("3", "12-10-2024", "2", "x"), nine("J3", "12-10-2024", "2", "0"), nine("3", "12-10-2031", "2", "0"), nine("3", "2024", "2", "0"), nine("3", "12-10-2024", "2", "0", " "), ["jornada 8"], ["05/11/2022", "", "A", "-", "2", "B", "Campo"], ["a", "b"],
    ]
    rows = spark.createDataFrame([("p", i, c) for i, c in enumerate(cells)] + [("q", 0, cells[3])], "page_id string, pos int, cells array<string>")
    got = [tuple(r) for r in extract.calendar_rows(rows).orderBy("pos").collect()]
    assert got == [("p", 3, "7", "2023-03-04", "A", 1, 2, "B"), ("p", 4, "3", "2024-10-12", "A", 2, 0, "B"), ("p", 5, "3", "2024-10-12", "A", None, None, "B"), ("p", 11, "8", "2022-11-05", "A", None, None, "B")]
