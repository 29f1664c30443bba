"""The two searches against brute force, with awkward rows."""

import numpy as np
import pyarrow as pa
import pytest

from tallyfield.llm import ann, knn

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, mark string, score string, cell string"


def rows(n=700, dim=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    out = [(i, [float(v) for v in x[i]]) for i in range(n)]
    out += [(2000 + i, out[7][1]) for i in range(60)]  # one vector many times
    out += [(3000, None), (3020, [0.0] * dim), (3040, [float("nan")] * dim), (3060, [float("inf")] + [1.0] * (dim - 1)), (3080, [1.0] * (dim - 1) + [None]), (3100, [1.0]), (None, [1.0] * dim), out[20], out[20]]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in data], SCHEMA)


def brute(data, every, k, values, zero):
    good = {(i, tuple(v)) for i, v in data if i is not None and v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))}
    good = [(i, values(np.array(v))) for i, v in sorted(good)]
    out = {}
    for i, v in good:
        if i % every == 0:
            best = sorted((-float((w * v).sum()), j) for j, w in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_exact_search(spark):
    data = rows()
    got = collected(knn.top_k(frame(spark, data), k=10, every=20))
    assert got == brute(data, 20, 10, lambda v: np.floor(1024 * v.astype(np.float64)), True)


def test_exact_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    monkeypatch.setattr(knn, "HOME_ROWS", 30)
    data = rows(seed=3)
    got = collected(knn.top_k(frame(spark, data).repartition(5), k=10, every=20))
    assert got == brute(data, 20, 10, lambda v: np.floor(1024 * v.astype(np.float64)), True)


@pytest.mark.parametrize("copies", [2, 15])
def test_exact_search_where_every_row_repeats(spark, copies):
    data = [(i, v) for i, v in rows(300, seed=5) if i is not None and i < 300]
    got = collected(knn.top_k(frame(spark, data * copies).repartition(3), k=10, every=1000))
    assert got == brute(data, 1000, 10, lambda v: np.floor(1024 * v.astype(np.float64)), True)
    assert len(got[0]) == 10


def test_exact_search_where_an_id_has_many_vectors(spark):
    """One id holds the 30 best vectors: it counts once, by its best, and hides nobody."""
    data = [(i, v) for i, v in rows(300, seed=6) if i is not None and i < 300]
    query = np.array(data[0][1])
    data += [(999, [float(c) for c in np.float32(query * (3 + j / 10))]) for j in range(30)]
    got = collected(knn.top_k(frame(spark, data).repartition(3), k=10, every=1000))
    best = {}
    for i, v in data[1:]:
        q, x = (np.floor(1024 * np.array(w)) for w in (data[0][1], v))
        best[i] = max(best.get(i, -np.inf), float(q @ x))
    assert got == {0: sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10]}


def test_clusters_are_pruned(spark):
    """Far clusters: the join stays exact, and few cells are opened beyond a query's home."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 8)) * 20
    data = [(i, [float(v) for v in np.float32(centers[i % 30] + rng.normal(size=8) * 0.1)]) for i in range(6000)]
    assert collected(knn.top_k(frame(spark, data), k=5, every=100)) == brute(data, 100, 5, lambda v: np.floor(1024 * v.astype(np.float64)), True)
    x = np.floor(1024 * np.array([v for _, v in data]))
    pivots = knn.choose_pivots(x, 20)
    table = spark.createDataFrame([(v.astype(int).tolist(),) for v in x], "vec array<long>")
    cells = knn.summarized(table, pivots)
    assert cells.n.sum() == 6000
    q, scores = x[::100], x[::100] @ x.T
    home = cells.home(q, 512)
    own = knn.nearest_pivot(x, pivots)[0]
    least = np.array([np.sort(s[h[own]])[-6] for s, h in zip(scores, home, strict=True)])
    opened = ~home & (cells.highest(q) >= least[:, None])
    assert (cells.n[None, :] * opened).sum() < 0.1 * 60 * 6000


def test_bounds_hold():
    """No row exceeds its cell's bound, whatever its norm and direction."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 5)) * rng.lognormal(5, 2, 500)[:, None])
    x[:5] = 0
    pivots = np.concatenate((knn.choose_pivots(x, 12), np.zeros((1, 5))))
    own, apart = knn.nearest_pivot(x, pivots)
    norm, angle = np.linalg.norm(x, axis=1), knn._angles(x, pivots[own])
    each = [own == c for c in range(13)]
    top = lambda v: np.array([v[e].max(initial=0) for e in each])
    cells = knn.Cells(pivots, np.array([e.sum() for e in each]), top(apart), np.array([norm[e].min(initial=np.inf) for e in each]), top(norm), top(angle))
    assert (x @ x.T <= cells.highest(x)[:, own] + 1e-6).all()
    assert (cells.home(x, 50) @ cells.n >= 50).all()


def recall(spark, x, every, **settings):
    """Share of the true 20 nearest that are found."""
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    got, hits = collected(ann.nearest(spark.createDataFrame(table), k=20, every=every, **settings)), 0
    for q, found in got.items():
        scores = x.astype(np.float64) @ x[q].astype(np.float64)
        scores[q] = -np.inf
        hits += len({j for j, _ in found} & set(np.argsort(-scores)[:20].tolist()))
    assert len(got) == len(range(0, len(x), every))
    return hits / (20 * len(got))


def scored_share(x, queries, share):
    """Rows in the leaves that a query takes, as a share of all rows."""
    norm = float(np.linalg.norm(x, axis=1).max())
    lifted = ann.lifted(x, norm)
    forest = [ann.grow(lifted, ann.LEAST_LEAVES, s) for s in range(ann.TREES)]
    leaf = [t.leaf(lifted) for t in forest]
    sizes = np.stack([np.bincount(at, minlength=t.leaves) for t, at in zip(forest, leaf, strict=True)])
    shares = []
    for q in ann.aimed(x[queries], norm):
        taken = np.zeros(sizes.shape, bool)
        taken[tuple(np.array(ann.search(forest, sizes, q, share * len(x))).T)] = True
        shares.append(np.any([taken[t][at] for t, at in enumerate(leaf)], axis=0).mean())
    return float(np.mean(shares))


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
def test_forest_recall_without_clusters(spark, spread):
    """20,000 vectors of one norm and of many: 0.9 is reached with under half of the rows scored."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None] * rng.lognormal(0, spread, len(x))[:, None]).astype(np.float32)
    assert recall(spark, x, 400) >= 0.9
    assert scored_share(x.astype(np.float64), range(0, 20_000, 2000), ann.SEARCH) < 0.5


def test_forest_recall_on_small_tables(spark):
    rng = np.random.default_rng(1)
    for n in (500, 2000):
        x = rng.normal(size=(n, 64))
        assert recall(spark, (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32), 20) >= 0.9


def test_forest_recall_in_clusters(spark):
    """Where vectors form clusters a twentieth of the search is enough."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 64))[rng.integers(100, size=20_000)] + 0.3 * rng.normal(size=(20_000, 64))
    assert recall(spark, x.astype(np.float32), 400, share=0.05) >= 0.9
    assert scored_share(x, range(0, 20_000, 2000), 0.05) < 0.05


def test_forest_that_searches_everything_is_exact(spark):
    data = rows(300)
    got = collected(ann.nearest(frame(spark, data), k=20, every=20, share=100.0))
    assert got == brute(data, 20, 20, lambda v: v.astype(np.float32).astype(np.float64), False)


def test_leaves_are_taken_best_first():
    """In order of the summed margins, which are worked out here path by path."""
    x = np.random.default_rng(0).normal(size=(400, 5))
    trees = [ann.grow(x, 8, s) for s in range(3)]
    sizes = np.stack([np.bincount(t.leaf(x), minlength=8) for t in trees])

    def value(t, leaf):
        node, total = leaf + 8, 0.0
        while node > 1:
            margin = trees[t].normals[node // 2] @ x[0] - trees[t].offsets[node // 2]
            total, node = total + (margin if node % 2 else -margin), node // 2
        return total

    found = ann.search(trees, sizes, x[0], 10**9)
    assert len(found) == len(set(found)) == 24
    assert found == sorted(found, key=lambda f: -value(*f))
    assert ann.search(trees, sizes, x[0], 60) == found[: 1 + np.flatnonzero(np.cumsum([sizes[f] for f in found]) >= 60)[0]]


@pytest.mark.parametrize("search", [lambda v: ann.nearest(v), lambda v: knn.top_k(v)])
def test_nothing_to_search(spark, search):
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert search(frame(spark, [(3000, None), (7, [1.0] * 8)])).count() == 0
    assert search(frame(spark, [(0, [1.0] * 8)])).count() == 0
    assert [tuple(r)[:3] for r in search(frame(spark, [(0, [1.0] * 8), (1, [2.0] * 8)])).collect()] == [(0, 1, 1)]
