"""The distribution rules against a plain version, with awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict
from statistics import median

import pytest

from tallyfield.llm import divergence as D
from tests.llm.edge import SCHEMA, corpus, frame, words

CLASS = [re.compile(p) for p in ("[a-zäöüßéèêçñóíï]", "[A-ZÄÉ]", "[日本]", "[0-9]", r"[\x20\x09-\x0D]", r"[#*$%&|<>]")]


def repeated(ws):
    at = defaultdict(list)
    for i in range(len(ws) - 2):
        at[tuple(ws[i : i + 3])].append(i)
    return len({i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)})


def measured(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    counts = [sum(bool(c.match(x)) for x in text) for c in CLASS]
    rest = len(text) - sum(counts)
    counts[3] = len(re.findall("[0-9]+", text))
    return [len(ws), sum(map(len, ws)), counts[5], len(lines) - len(set(lines)), repeated(ws), [*counts, rest]]


def distance(p, q):
    p, q = ([x / sum(v) for x in v] for v in (p, q))
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2))


def brute(rows):
    """Rows of (doc_id, text, lang): everything the operator returns, from its definition."""
    out, shares, word_shares = [], defaultdict(list), defaultdict(list)
    for d, t, lang in rows:
        m = measured(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        runs = re.findall(r"[^\W\d_]+", (t or "").lower())
        n = Counter(runs)
        common = [n[w] for w in D.COMMON_WORDS[lang]] if lang in D.COMMON_WORDS else None
        common = common and [*common, len(runs) - sum(common)]
        out.append((d, lang, m, failed, common))
        if not failed:
            shares[lang].append([1000 * x // sum(m[5]) for x in m[5]])
            if common and len(runs) >= D.LEAST_RUNS:
                word_shares[lang].append([1000 * x // len(runs) for x in common])
    middle = lambda v: [median(x) for x in zip(*v)]
    pooled = middle([x for v in shares.values() for x in v])
    kept = []
    for d, lang, m, failed, common in out:
        own = lang is not None and len(shares[lang]) >= D.LEAST_DOCUMENTS
        a = distance(m[5], middle(shares[lang]) if own else pooled) if sum(m[5]) and pooled else None
        b = distance(common, middle(word_shares[lang])) if own and common and sum(common) >= D.LEAST_RUNS else None
        good = not failed and (a is None or a <= D.MOST_CLASS_DISTANCE) and (b is None or b <= D.MOST_WORD_DISTANCE)
        kept.append((d, *m[:5], failed, good))
    return sorted(kept, key=str)


def prose(i, lang="en"):
    """Clean text of a made-up vocabulary with the language's common words."""
    r, common = random.Random(i), D.COMMON_WORDS.get(lang, D.COMMON_WORDS["es"])
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))
    drawn = [r.choice(common[:7]) if r.random() < 0.3 else word() + "." * (r.random() < 0.1) for _ in range(150 + i)]
    return " ".join(drawn).capitalize()


def texts():
    rows = [(i, prose(i, lang), lang) for i, lang in enumerate(["en"] * 40 + ["de"] * 35 + ["fr"] * 5 + ["xx"] * 40)]
    junk = {"shout": prose(3).upper(), "signs": prose(4).replace(" ", "&&& "), "table": prose(5).replace(" ", " | "), "no common words": re.sub(r"\b(the|of|and|to|a|in|is)\b", "qqq", prose(6)), "again": "One two three four. " * 40, "numbers": " ".join(str(10**9 + 7919 * i) for i in range(80))}
    rows += [(500 + 10 * i, t, lang) for i, t in enumerate(junk.values()) for lang in ("en", "fr", "zz", None)]
    rows += [(900, None, "en"), (901, "", None), (902, " \n\t", "de"), (903, "a b\na b\nc\na b\n \n \n", "en"), (904, prose(7) + "\n" + prose(7), "en"), (905, "x\x1cy z\x0bw", "en"), (None, prose(8), "en"), (None, None, None)]
    return rows + [rows[0], rows[0], (906, "the " * 30 + prose(9) * 30, "en")]


def result(spark, rows):
    df = spark.createDataFrame([(d, t, g, "s", 0, *["x"] * 13, "x", "x", True) for d, t, g in rows], SCHEMA + ", classes string, lang_ string, kept boolean")
    got = D.quality_rules(df).drop("class_distance", "word_distance").collect()
    assert got[0].__fields__ == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] if got else True
    return sorted((tuple(r) for r in got), key=str)


def test_rules(spark):
    rows = texts()
    got = result(spark, rows)
    assert got == brute(rows)
    verdict = {r[0]: r[-1] for r in got}
    assert all(verdict[i] for i in range(80))
    assert not any(verdict[i] for i in (500, 510, 520, 540, 550))


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_on_the_awkward_corpus(spark, seed):
    rows = [(d, t, "en") for d, t, _ in corpus(seed)]
    got = sorted((tuple(r) for r in D.quality_rules(frame(spark, [(d, t, None) for d, t, _ in rows])).drop("class_distance", "word_distance").collect()), key=str)
    assert got == brute(rows)


def test_references_do_not_follow_a_hot_group_of_junk(spark):
    """Copies of one shouted text are a third of a language: clean documents stay, the copies go."""
    rows = [(i, prose(i), "en") for i in range(60)] + [(1000 + i, prose(3).upper(), "en") for i in range(30)]
    verdict = {r[0]: r[-1] for r in result(spark, rows)}
    assert [i for i, kept in verdict.items() if not kept] == [1000 + i for i in range(30)]


def test_empty_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None, None)]) == [(1, 0, 0, 0, 0, 0, True, False)]


def test_nothing_but_sql_functions(spark, small):
    plan = D.document_counts(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Cartesian", plan)
