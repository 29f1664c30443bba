"""A small corpus with every awkward row, and brute-force versions of what operators compute."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size string, score string, node string, label string, key string, shard string, copies string, kept_text string, begins string, chunk string, target string, text_hash string"


def words(text):
    return WORD.findall(text or "")


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): copies, edited copies, shared passages, odd spaces, nulls, ties and one very long text."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ärger,", "naïve", "x<|y", "don't", "日本", "..."]
    make = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    rows = [(i, make(r.randint(1, 120)), f"s{i % 5}") for i in range(n)]
    base, passage = make(100), make(30)
    for i in range(6):
        edited = base.split()
        edited[10 * i] = f"edit{i}"
        rows.append((n + i, " ".join(edited), "s0"))
    rows += [(n + 10 + i, base, "s0") for i in range(5)]
    rows += [(n + 20 + i, f"{make(10)} {passage} {make(10)}", "s1") for i in range(4)]
    rows += [(n + 30, f"{passage} {passage} {passage}", None), (n + 31, None, "s2"), (n + 32, "", "s2"), (n + 33, " \t\n", None), (n + 34, "a b\x1cc d\x0be", "s3")]
    rows += [(n + 40, " ".join(["same"] * 300), "s3"), (n + 41, make(20000), "s4"), (None, make(50), "s1"), (None, None, None)]
    rows += [rows[3], rows[3]]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    """The rows with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), *["x"] * 13) for d, t, s in rows], SCHEMA)
