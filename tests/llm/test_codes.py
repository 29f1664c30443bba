"""Part codes against plain search, with ties, repeats and awkward vectors."""

import hashlib

import numpy as np
import pytest

from tallyfield.llm import codebooks as C

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, vec string, of string, salt string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, *["x"] * 5) for i, v, g in rows], SCHEMA)


def nearest(x, entries):
    apart = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    index = apart.argmin(axis=1)
    return index, apart[np.arange(len(x)), index]


def brute(rows, width):
    good = [(i, v, g) for i, v, g in rows if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v, _ in good], np.int64)
    x = np.pad(x, ((0, 0), (0, -width % 16)))
    first = {}
    for (i, _, _), v in zip(good, x):
        if i is not None:
            first[i] = min(first.get(i, list(v)), list(v))
    start = np.array([first[i] for i in sorted(first)[:64]])
    parts = np.split(x, 16, axis=1)
    books = np.split(start, 16, axis=1)
    for _ in range(2):
        for p in range(16):
            index, _ = nearest(parts[p], books[p])
            for e in set(index):
                given = parts[p][index == e]
                books[p][e] = [int(s) // len(given) for s in given.sum(axis=0)]
    found = [nearest(parts[p], books[p]) for p in range(16)]
    codes = np.stack([i for i, _ in found], axis=1)
    error = np.sum([d for _, d in found], axis=0)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    by = {}
    for (_, _, g), e in zip(good, error):
        by[g] = by.get(g, 0) + int(e)
    return sorted(((i, g, "".join(f"{c:02x}" for c in code), int(e), by[g], digest) for (i, _, g), code, e in zip(good, codes, error)), key=str)


def made(n, width, seed=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, width)) * 2) / 64  # few values: many ties
    rows = [(int(i), [float(c) for c in v], int(g)) for i, v, g in zip(r.permutation(n) * 3, x, r.integers(0, 4, n))]
    rows += [(7001 + i, rows[5][1], 9) for i in range(40)]
    rows += [(8000, None, 1), (8001, [float("nan")] * width, 1), (8002, [float("inf")] + [0.0] * (width - 1), 1), (8003, [None] + [0.0] * (width - 1), 1), (8004, [1.0], 1), (8005, [], 1), (None, [0.5] * width, None), (8006, [0.0] * width, None), (0, [-1.0] * width, 2), rows[3], rows[3]]
    return rows


def collected(df):
    return sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("n,width", [(500, 64), (90, 16), (40, 32), (120, 20)])
def test_codes(spark, n, width):
    rows = made(n, width, seed=n)
    assert collected(C.compress(frame(spark, rows).repartition(5))) == brute(rows, width)


def test_codes_with_many_labels(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_LABELS", 2)
    rows = made(200, 16, seed=4)
    assert collected(C.compress(frame(spark, rows))) == brute(rows, 16)


def test_empty_tables(spark):
    assert C.compress(frame(spark, [])).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert C.compress(frame(spark, [(1, None, 2), (2, [], 2)])).collect() == []


def test_huge_components(spark):
    rows = [(i, [1e300 * (-1) ** (i + j) for j in range(16)], 1) for i in range(70)] + [(100 + i, [float(i)] * 16, 2) for i in range(5)]
    got = C.compress(frame(spark, rows)).collect()
    assert len(got) == 75 and all(r["error"] >= 0 for r in got)


@pytest.mark.parametrize("entries,width", [(64, 4), (64, 1), (9, 3), (1, 2)])
def test_tree_finds_the_lowest_of_equal_entries(entries, width):
    r = np.random.default_rng(entries + width)
    book = r.integers(-3, 4, (entries, width))
    x = r.integers(-6, 7, (3000, width))
    index, apart = C.KdTree(book).nearest(x)
    expected = nearest(x, book)
    assert (index == expected[0]).all() and (apart == expected[1]).all()
