"""Quality rules by distribution: what a text's characters and common words look like beside its language's.

Everything is a Spark SQL expression over one row, so a text is read in place and nothing but its counts is
kept: a few dozen numbers for each document, written once.  References are medians, over all documents of a
language that pass the base rules, of the shares that each class or word has in a document.  A median is not
moved by a hot group of copies or by junk as long as that is less than half, and shares in thousandths bound the
state of the aggregation.  A document is kept if the Jensen-Shannon distance of its characters, and that of its
common words where it has enough words for a histogram, stay within the limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import WORD, materialize

#: Base rules: fewest words, and the largest share (per cent) of words in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a document from its language.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.16, 0.3
#: Letter runs below which a document has no histogram of common words worth comparing.
LEAST_RUNS = 100
#: A language needs as many documents for a reference of its own; the others are held against all documents.
LEAST_DOCUMENTS = 30
#: References are broadcast: those of the most frequent languages, at most (a few hundred bytes each).
MOST_LANGUAGES = 1000

#: The most common function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "su", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "par", "qui", "dans"],
}
#: Character classes: lower case, upper case, other letters, digits, white space, symbols; what is left is the last.
CLASSES = [r"\p{Ll}", r"\p{Lu}", r"\p{L}", r"\p{N}", r"\x20\x09-\x0D", r"#*$%&|<>"]


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def left_over(text: Column, pattern: str) -> Column:
    """``text`` without what matches."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(ws: Column) -> Column:
    """Words in three-word windows that stand at two places or more of the text.

    Windows are sorted with their places, so equal ones are neighbours; the words at the places found count once.
    The sort compares 64-bit hashes first and the windows themselves after that.
    """
    words = lambda i: [F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)]
    window = lambda i: F.struct(F.xxhash64(*words(i)).alias("hash"), F.concat_ws(" ", *words(i)).alias("window"), i.alias("at"))
    windows = F.when(F.size(ws) > 2, F.transform(F.sequence(F.lit(0), F.size(ws) - 3), window))

    def repeats(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["window"] == x["window"]) | (F.get(s, i + 1)["window"] == x["window"])
        at = F.transform(F.filter(s, same), lambda x: x["at"])
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

    return F.coalesce(let(F.sort_array(windows), repeats), F.lit(0)).cast("long")


def class_counts(text: Column) -> Column:
    """Code points of each character class, in the order of ``CLASSES``, and the rest; a number counts as one, however long.

    Each class is taken out of what the classes before it left, so that only the first pass reads the whole text.
    """

    def taken(rest: Column, classes: list[str], counts: list[Column]) -> Column:
        size = F.char_length(rest).cast("long")
        if not classes:
            lower, upper, letters, _, space, symbols = counts
            return F.array(lower, upper, letters, F.regexp_count(text, F.lit(r"\p{N}+")).cast("long"), space, symbols, size)
        return let(left_over(rest, f"[{classes[0]}]+"), lambda x: taken(x, classes[1:], [*counts, size - F.char_length(x)]))

    return taken(text, CLASSES, [])


def word_counts(text: Column, lang: Column) -> Column:
    """Letter runs that are each of the language's common words, and the rest; null for a language without a list."""
    known = F.create_map(*[x for k, ws in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])
    common = F.try_element_at(known, lang)
    any_common = sorted({w for ws in COMMON_WORDS.values() for w in ws})

    def counted(runs: Column) -> Column:
        found = lambda m: F.transform(common, lambda c: F.size(F.filter(m, lambda w: w == c)).cast("long"))
        with_rest = lambda n: F.concat(n, F.array(F.size(runs).cast("long") - total(n)))
        return let(let(F.filter(runs, lambda w: w.isin(any_common)), found), with_rest)

    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return F.when(common.isNotNull(), let(runs, counted))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, classes, common: one row a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    base = let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words")))
    counted = docs.select(
        "doc_id",
        "lang",
        base.alias("base"),
        F.char_length(text).cast("long").alias("length"),
        repeated_lines(text).alias("n_dup_lines"),
        class_counts(text).alias("classes"),
        word_counts(text, F.col("lang")).alias("common"),
    )
    space, symbols = F.col("classes")[4], F.col("classes")[5]
    counted = counted.select("doc_id", "lang", "base.*", (F.col("length") - space).alias("word_chars"), symbols.alias("n_symbols"), "n_dup_lines", "classes", "common")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _medians(counts: str, size: int, usable: Column) -> Column:
    """Median share, in thousandths, of each class over the documents that are ``usable``."""
    share = lambda i: F.when(usable, F.floor(1000 * F.col(counts)[i] / total(F.col(counts))))
    return F.array(*[F.percentile(share(i), F.lit(0.5)) for i in range(size)])


def references(counts: DataFrame) -> DataFrame:
    """lang, pooled, n, classes, common: median shares by language, and over all documents where ``pooled``."""
    enough = F.coalesce(total(F.col("common")) >= LEAST_RUNS, F.lit(False))
    lists = len(next(iter(COMMON_WORDS.values()))) + 1
    by = counts.where(~F.col("base_failed")).rollup("lang")
    return by.agg((F.grouping("lang") == 1).alias("pooled"), F.count("*").alias("n"), _medians("classes", len(CLASSES) + 1, F.lit(True)).alias("classes"), _medians("common", lists, enough).alias("common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of weights; null where one is null or weighs nothing."""

    def between(both: Column) -> Column:
        part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
        terms = F.zip_with(both["p"], both["q"], lambda x, y: part(x, y) + part(y, x))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))

    def scaled(x: Column) -> Column:
        whole = F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
        return let(whole, lambda t: F.when(t > 0, F.transform(x, lambda y: y / t)))

    p, q = (scaled(F.transform(x, lambda y: y.cast("double"))) for x in (p, q))
    return let(F.struct(p.alias("p"), q.alias("q")), between)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance and kept for each row of (doc_id, text, lang).

    Null texts count as empty; repeated rows stand for themselves.  A language that is null, or that fewer than
    ``LEAST_DOCUMENTS`` documents have, or that is not among the ``MOST_LANGUAGES`` most frequent, is compared by
    characters with all documents and not by words, as are languages without a list of common words; texts with
    fewer than ``LEAST_RUNS`` letter runs are not compared by words either.  Other columns are ignored; an empty
    table gives no rows.
    """
    counts = materialize(document_counts(docs.select("doc_id", "text", "lang")), "divergence-counts")
    found = materialize(references(counts), "divergence-references")
    by_language = found.where(~F.col("pooled") & F.col("lang").isNotNull() & (F.col("n") >= LEAST_DOCUMENTS)).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    pooled = found.where("pooled").first()
    everywhere = F.array(*map(F.lit, pooled["classes"])) if pooled and pooled["n"] else F.lit(None).cast("array<double>")
    near = F.broadcast(by_language.select("lang", F.col("classes").alias("usual_classes"), F.col("common").alias("usual_common")))
    held = counts.join(near, "lang", "left")
    held = held.withColumn("class_distance", distance(F.col("classes"), F.coalesce("usual_classes", everywhere)))
    held = held.withColumn("word_distance", F.when(total(F.col("common")) >= LEAST_RUNS, distance(F.col("common"), F.col("usual_common"))))
    within = lambda c, most: F.coalesce(F.col(c) <= most, F.lit(True))
    kept = ~F.col("base_failed") & within("class_distance", MOST_CLASS_DISTANCE) & within("word_distance", MOST_WORD_DISTANCE)
    return held.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance")
