"""Name normalisers.  They differ on purpose: each kind of key has its own rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the plain letters they stand for.
_MARKED = "áàäâãåéèëêíìïîóòöôõúùüûñçýÿÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
# Tokens that badge keys leave out.
BADGE_TOKENS = ("CF", "UD", "CD", "AD", "SD", "AFC", "SC", "CP", "CE", "CEF", "SSD", "ATLETICO", "ATL")
# Words that say nothing about which team it is when names are scored.
NOISE = (
    "CF", "CD", "UD", "AD", "SD", "FC", "CFS", "CDF", "SAD", "CB", "EF", "EDF", "CLUB", "DEPORTIVO", "DEPORTIVA", "ATLETICO", "ATCO", "ATL", "REAL",
    "BALOMPIE", "ESCUELA", "FUTBOL", "FUNDACION", "ASOCIACION", "SOCIEDAD", "DE", "DEL", "LA", "EL", "LOS", "LAS", "Y",
)
# Dotted abbreviations, which go as a whole so that their last letter is not taken for a team's.
DOTTED = r"\b(?:[A-Za-zÁÉÍÓÚÑ]\.){2,}"
# The abbreviations and words that reconciliation and team keys leave out, in this order.
CLUB_WORDS = (r"c\s*f", r"c\s*d", r"c\s*d\s*f", r"u\s*d", r"a\s*d", r"s\s*d", r"s\s*c", r"s\s*a\s*d", r"e\s*f", r"c\s*p", r"c\s*e", "club", "deportivo", "atletico", r"atletico\s+c\s*f", "deportiva", "sociedad", "union", r"f\s*c")
# Quotes and punctuation that count as spaces there.
SPACING = r"[\"'‘’“”.,;:]"
# Words that stand for a free round instead of an opponent.
BYE_WORDS = ("DESCANSA", "DESCANSO", "DESCANSAN")


def without_marks(text: Column) -> Column:
    """Accented letters as plain ones: Latin-1 letters by table, combining marks dropped."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{M}", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _without_tokens(text: Column, tokens=CLUB_WORDS) -> Column:
    return F.regexp_replace(text, r"\b(" + "|".join(tokens) + r")\b", " ")


def badge_key(name: Column) -> Column:
    """Marks and quotes, dots and commas go, club tokens go, lower case, single spaces."""
    bare = F.regexp_replace(without_marks(name), r"[\"',.‘’“”]", "")
    return squeezed(F.lower(F.regexp_replace(bare, r"(?i)\b(" + "|".join(BADGE_TOKENS) + r")\b", "")))


def _plain(name: Column) -> Column:
    return F.regexp_replace(without_marks(name), r"[^\x00-\x7F]", "")


def reconciliation_key(name: Column) -> Column:
    """Plain lower-case letters; punctuation becomes space; club words and a last letter a-d go."""
    spaced = F.regexp_replace(F.lower(_plain(name)), SPACING, " ")
    return squeezed(F.regexp_replace(_without_tokens(spaced, CLUB_WORDS), r"\b[abcd]\b\s*$", ""))


def team_key(name: Column) -> Column:
    """As :func:`reconciliation_key`, but a last letter, which tells a club's teams apart, stays.

    Here punctuation becomes space first, so that curly quotes separate words.
    """
    spaced = F.regexp_replace(name, SPACING, " ")
    return squeezed(_without_tokens(F.lower(_plain(spaced)), CLUB_WORDS))


def folded(name: Column) -> Column:
    """No marks, upper case, every other sign a space."""
    return squeezed(F.regexp_replace(F.upper(without_marks(name)), r"[^A-Z0-9]+", " "))


def player_key(name: Column) -> Column:
    """ASCII letters, single spaces, upper case."""
    return F.upper(squeezed(F.regexp_replace(without_marks(name), r"[^\x00-\x7F]", "")))


def is_bye(name: Column) -> Column:
    return folded(name).isin(*BYE_WORDS)


def _undotted(name: Column) -> Column:
    return folded(F.regexp_replace(name, DOTTED, " "))


def filial(name: Column) -> Column:
    """The letter A-F at the end of a team's name of more words, or null; of several the last counts."""
    found = F.regexp_extract(_undotted(name), r" ([A-F])$", 1)
    return F.when(found != "", found)


def core_tokens(name: Column, noise=NOISE) -> Column:
    """The distinct words that tell a team from others: no letters at the end, no single letters, no noise.

    A name of nothing else keeps all its words.
    """
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(_undotted(name), r"( [A-F])+$", ""), " "), lambda w: w != ""))
    core = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*noise))
    return F.when(F.size(core) > 0, core).otherwise(words)


def without_cup_marks(name: Column) -> Column:
    """Notes such as (Clasificado), (Ganador) or (P) go."""
    return squeezed(F.regexp_replace(name, r"(?i)\((clasificado|ganador|p)\)", " "))


def single_quoted_letter(name: Column) -> Column:
    """A letter that is given bare and again in quotes is given once, in quotes."""
    return F.regexp_replace(name, r"\b([A-Z])\s+\"\1\"", '"$1"')


def initials(name: Column) -> Column:
    """Two letters of a name of one word, else the first letters of the first three; only letters and spaces count."""
    words = F.split(F.trim(F.regexp_replace(name, r"[^a-zA-ZáéíóúñÁÉÍÓÚÑüÜ\s]", "")), r"\s+")
    first = F.concat_ws("", F.transform(F.slice(words, 1, 3), lambda w: F.substring(w, 1, 1)))
    return F.upper(F.when(F.size(words) == 1, F.substring(words[0], 1, 2)).otherwise(first))


def name_hue(name: Column) -> Column:
    """A hue 0..359 from the times-31 hash; only its shift by five bits is cut to 32 bits, the sum is not."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.pmod(F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrapped(h * 32) - h + c)), F.lit(360)).cast("int")


def html_escaped(text: Column) -> Column:
    out = text
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def short_venue(venue: Column) -> Column:
    """A venue up to its first spaced dash, without a leading word for a ground; null is empty."""
    head = F.substring_index(F.coalesce(venue, F.lit("")), " - ", 1)
    return F.when(head.startswith("Campo "), F.substring(head, 7, 1 << 30)).otherwise(head)


def round_number(label: Column) -> Column:
    """The number in a round's label, or null."""
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("int")


# What a round's label says, in the order it is looked for, and the rounds before the final.
ROUND_WORDS = (("previa", "Previa"), ("dieciseis", "Dieciseisavos"), ("octavos", "Octavos"), ("cuartos", "Cuartos"), ("semifinal", "Semifinales"), (r"\bfinal\b", "Final"))
FROM_END = ("Final", "Semifinales", "Cuartos", "Octavos")


# How far a knock-out round is, by the first of these words in its label.
ROUND_RANKS = (("dieciseisavos", 1), ("octavos", 2), ("cuartos", 3), ("semifinal", 4), ("final", 5))


def round_sort_key(label: Column) -> Column:
    """struct<year, month, day, rank> that orders rounds: by the date in their label, then how far they are or their number."""
    lower, day = F.lower(label), r"(\d{2})-(\d{2})-(\d{4})"
    part = lambda i: F.coalesce(F.regexp_extract(label, day, i).try_cast("int"), F.lit(0))
    rank = F.coalesce(*[F.when(lower.contains(word), n) for word, n in ROUND_RANKS], round_number(F.regexp_replace(label, day, "")), F.lit(0))
    return F.struct(part(3).alias("year"), part(2).alias("month"), part(1).alias("day"), rank.alias("rank"))


def round_name(label: Column, to_final: Column) -> Column:
    """A knock-out round's name: the one in its label, else by its distance from the final, else the label's number."""
    named = F.coalesce(*[F.when(F.lower(label).rlike(k), v) for k, v in ROUND_WORDS])
    counted = F.coalesce(*[F.when(to_final == i, name) for i, name in enumerate(FROM_END)])
    number = F.regexp_extract(label, r"(?i)Ronda\s+(\d+)", 1)
    bare = F.trim(F.regexp_replace(label, r"\d{2}-\d{2}-\d{4}\s*", ""))
    return F.coalesce(named, counted, F.when(number != "", F.concat(F.lit("Ronda "), number)), bare)


# Signs for phases by their exact names, which come first, and by words that their names hold.
NAMED_PHASES = {"Segunda Fase A": "🏆", "Segunda Fase B": "🥈", "Segunda Fase C": "🥉", "Lanzarote": "🌋", "Fuerteventura": "🏝️", "Gran Canaria": "🏔️", "Primera Fase GC": "🏟️", "Primera Fase": "🏟️"}
PHASE_SIGNS = (("copa", "🏆"), ("campeon", "🏆"), ("campeón", "🏆"), ("lanzarote", "🌋"), ("fuerteventura", "🏝️"), ("gran canaria", "🏔️"), (" gc", "🏔️"))
OTHER_SIGN = "⚽"


def phase_sign(phase: Column) -> Column:
    """The sign of a phase of exactly this name, else of the first word that it holds."""
    named = [F.when(phase == k, v) for k, v in NAMED_PHASES.items()]
    lower = F.lower(F.coalesce(phase, F.lit("")))
    return F.coalesce(*named, *[F.when(lower.contains(k), v) for k, v in PHASE_SIGNS], F.lit(OTHER_SIGN))


def shown_group(name: Column, category: Column) -> Column:
    """A group's name as scorer lists show it, from its full name and its category."""
    upper = F.upper(name)
    bare = F.concat(F.lit("BENJAMIN "), F.trim(F.regexp_replace(upper, r"\bBENJAMIN\b\s*", "")))
    younger, island = F.regexp_extract(upper, r"G-?(\d+)", 1), F.regexp_extract(upper, r"GRUPO\s*(\d+)", 1)
    small = F.when(younger != "", F.concat(F.lit("PREBENJAMIN GC GRUPO "), younger)).otherwise(upper)
    lanzarote = ~upper.contains("FUERTEVENTURA") & upper.contains("LANZAROTE") & (island != "")
    return F.when(category == "PREBENJAMIN", small).when(lanzarote, F.concat(F.lit("BENJAMIN PRIMERA LANZAROTE G"), island)).otherwise(bare)


# Signs in a scorer list's group name and the codes they give, in the order they are looked for.
LEAGUE_CODES = (("ORO", "FO"), ("PLATA", "FP"), ("BRONCE", "FB"))
NUMBERED_GROUPS = ((r"LANZAROTE\s+G(\d+)", "LZ"), (r"FASE\s+([A-C]-G\d+)", ""), (r"PREBENJAMIN\s+GC\s+GRUPO\s+(\d+)", "PG"))


def scorer_group_code(name: Column) -> Column:
    """The code of a group from its name in scorer lists (see :func:`shown_group`), or null."""
    upper = F.upper(name)
    leagues = [F.when(upper.contains("FUERTEVENTURA") & upper.contains(word), code) for word, code in LEAGUE_CODES]
    numbered = lambda pattern, code: F.concat(F.lit(code), F.replace(F.nullif(F.regexp_extract(upper, pattern, 1), F.lit("")), F.lit("-G"), F.lit("")))
    return F.coalesce(*leagues, *[numbered(pattern, code) for pattern, code in NUMBERED_GROUPS])


# The codes that slugs of first phases stood for, with the seasons (by their first year) that used them.
SEASON_SLUGS = (
    (r"^1benjamin-prefe(\d+)$", "BPGC", (2021, 2022)),
    (r"^1benjamin(\d+)$", "GC", (2021, 2022, 2023)),
    (r"^1benjamin(\d+)$", "P", (2024,)),
    (r"^1prebenjamin(\d+)$", "PGC", (2021, 2022, 2023, 2024)),
)


def season_slug_code(slug: Column, season: Column) -> Column:
    """A group's code from its page's slug by the rules of its season (a first year), else the slug in capitals."""
    coded = [F.concat(F.lit(code), F.when(season.isin(*years), F.nullif(F.regexp_extract(slug, pattern, 1), F.lit("")))) for pattern, code, years in SEASON_SLUGS]
    return F.coalesce(*coded, F.upper(slug))


def season_phase(slug: Column, category: Column, season: Column) -> Column:
    """A group's phase: by category in the first two seasons and in the last, by its slug in the one between."""
    first = F.when(category == "benjamin_prefe", "Preferente GC").otherwise("Primera Fase GC")
    last = F.when(category == "prebenjamin", "Gran Canaria").otherwise("Primera Fase GC")
    return F.when(season <= 2022, first).when(season == 2023, slug_phase(slug)).otherwise(last)


def competition_code(prefix: Column, group_name: Column, unnumbered: str = "1") -> Column:
    """A competition's prefix (X if it has none) and the first number of a group's name."""
    number = F.nullif(F.regexp_extract(group_name, r"(\d+)", 1), F.lit(""))
    return F.concat(F.coalesce(prefix, F.lit("X")), F.coalesce(number, F.lit(unnumbered)))


def cup_code(category: Column, group_name: Column) -> Column:
    """The code of a knock-out: one for each phase A-E of the older category, one for the younger one."""
    phase = F.regexp_extract(F.upper(F.coalesce(group_name, F.lit(""))), r"FASE\s+([A-E])", 1)
    return F.when(category == "benjamin", F.concat(F.lit("BC"), phase, F.lit("1"))).otherwise("PCC1")


# Slugs of first phases and the codes that their numbers follow.
SLUG_CODES = ((r"^1benjamin(\d+)$", "P"), (r"^1prebenjamin(\d+)$", "PGC"))


def slug_code(slug: Column) -> Column:
    """A group's code from its page's slug: by the table of first phases, else the slug in capitals."""
    numbers = [(F.regexp_extract(slug, pattern, 1), code) for pattern, code in SLUG_CODES]
    return F.coalesce(*[F.when(n != "", F.concat(F.lit(code), n)) for n, code in numbers], F.upper(slug))


def _is_fuerteventura(slug: Column) -> Column:
    return F.lower(slug).contains("fuerteventura") | F.lower(slug).contains("fv")


def slug_phase(slug: Column) -> Column:
    s = F.lower(slug)
    second = s.startswith("2") | s.contains("segunda")
    return F.when(s.contains("lanzarote"), "Lanzarote").when(_is_fuerteventura(slug), "Fuerteventura").when(second, "Segunda Fase GC").otherwise("Primera Fase GC")


def slug_island(slug: Column) -> Column:
    return F.when(F.lower(slug).contains("lanzarote"), "lanzarote").when(_is_fuerteventura(slug), "fuerteventura").otherwise("grancanaria")


def slug_label(slug: Column) -> Column:
    """``Grupo N`` from the number that ends a slug."""
    n = F.regexp_extract(slug, r"(\d+)$", 1)
    return F.concat(F.lit("Grupo "), F.when(n != "", n).otherwise("?"))
