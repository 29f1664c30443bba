"""Hard negatives against plain scoring of all pairs."""

import numpy as np
import pytest

from tallyfield.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, mark string, cells string, block string, anchors string, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, *["x"] * 6) for i, v, g in rows], SCHEMA)


def brute(rows, width, every=100, k=5):
    good = {(i, g, tuple(np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int))) for i, v, g in rows if i is not None and g is not None and v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)}
    good = sorted(good)
    x = np.array([v for _, _, v in good], np.int64)
    out = []
    for (a, g, _), q in zip(good, x):
        if a % every:
            continue
        s = x @ q
        order = sorted((-int(s[j]), good[j][0], j) for j in range(len(good)) if good[j][0] != a)
        for _, _, p in [o for o in order if good[o[2]][1] == g][:k]:
            most = int(s[p])
            inside = [o for o in order if good[o[2]][1] != g and 80 * most <= -100 * o[0] <= 100 * most][:k]
            out += [(a, good[p][0], r + 1, i, most, -m) for r, (m, i, _) in enumerate(inside)]
    return sorted(out)


def made(n, width=16, seed=0, labels=4):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, width)) / 4).astype(np.float32)
    rows = [(i, [float(c) for c in v], int(g)) for i, (v, g) in enumerate(zip(x, r.integers(0, labels, n)))]
    rows += [(2000 + i, rows[100][1], i % 2) for i in range(60)]  # one vector under two labels
    rows += [(3000, None, 1), (3100, [0.0] * width, 1), (3200, [float("nan")] * width, 1), (3300, [float("inf")] + [1.0] * (width - 1), 1), (3400, [None] + [1.0] * (width - 1), 1), (3500, [1.0], 1), (3600, rows[7][1], None), (None, rows[7][1], 1), (3700, rows[9][1], 99), rows[200], rows[200]]
    return rows


def collected(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("seed,labels", [(0, 4), (1, 2), (2, 200), (3, 1)])
def test_negatives(spark, seed, labels):
    rows = made(700, seed=seed, labels=labels)
    got = collected(N.hard_negatives(frame(spark, rows).repartition(5)))
    assert got == brute(rows, 16)
    assert got or labels != 4


def test_negatives_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 90)
    monkeypatch.setattr(N, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(N, "SAMPLE_ROWS", 50)
    rows = made(700, seed=5)
    assert collected(N.hard_negatives(frame(spark, rows))) == brute(rows, 16)


def test_coarse_cells_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "CELLS", 4)
    rows = made(500, seed=6)
    assert collected(N.hard_negatives(frame(spark, rows))) == brute(rows, 16)


def test_empty_tables(spark):
    assert N.hard_negatives(frame(spark, [])).collect() == []
    assert N.hard_negatives(frame(spark, [(100, None, 1)])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert N.hard_negatives(frame(spark, [(100, [1.0, 2.0], 1)])).collect() == []


def test_bounds_hold_and_leave_most_rows_unscored():
    r = np.random.default_rng(2)
    x = np.floor(256 * r.normal(size=(5000, 64)) / 8).astype(np.int64)
    cells = N.cut(x[:500], x.min(axis=0), x.max(axis=0))
    codes = np.ascontiguousarray(cells.of(x).T.astype(np.intp))
    unscored = []
    for q in x[:20]:
        low, high = cells.tables(q)
        floor, ceiling, score = N.looked_up(low, codes), N.looked_up(high, codes), x @ q
        assert (floor <= score).all() and (score <= ceiling).all()
        unscored.append((ceiling < np.partition(floor, -6)[-6]).mean())
    assert np.mean(unscored) > 0.98
