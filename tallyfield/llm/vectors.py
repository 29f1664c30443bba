"""What the two vector searches share: valid vectors, exact top lists of a block, and merging packed lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block's best for one query: candidate ids and scores, best first.
LISTS = "query_id long, mark long, ids binary, scores binary"
LISTS_ARROW = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, finite), F.lit(False))


def common_length(vectors: DataFrame) -> int:
    """The most frequent length (ties: the smaller); vectors of other lengths take no part."""
    found = vectors.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def top_lists(queries: tuple, rows: tuple, k: int, product, exact, slack: float) -> pa.Table:
    """The ``k`` best rows of a block for each query, ties to smaller ids.

    ``queries`` and ``rows`` are (ids, marks, matrix); a row with a query's id is not its candidate, rows that
    agree in id and mark count once, and an id with several vectors has the best of their scores.  ``product`` scores all pairs fast; what comes within
    ``slack`` of the k-th best is scored by ``exact``, so that rounding decides no tie.
    """
    _, once = np.unique(np.stack((rows[0], rows[1])), axis=1, return_index=True)
    ids, x = rows[0][once], rows[2][once]
    begin = np.unique(ids, return_index=True)[1]
    _, asked = np.unique(np.stack((queries[0], queries[1])), axis=1, return_index=True)
    out = {c: [] for c in LISTS_ARROW.names}
    step = max(1, (1 << 22) // max(1, len(ids)))
    for lo in range(0, len(asked), step):
        part = asked[lo : lo + step]
        q = queries[2][part]
        scores = product(q, x)
        scores[queries[0][part][:, None] == ids[None, :]] = -np.inf
        if len(begin) > k:
            by_id = scores if len(begin) == len(ids) else np.maximum.reduceat(scores, begin, axis=1)
            least = np.partition(by_id, len(begin) - k, axis=1)[:, len(begin) - k]
        else:
            least = np.full(len(part), -np.inf)
        for i, row in enumerate(part):
            near = np.flatnonzero((scores[i] >= least[i] - slack) & (scores[i] > -np.inf))
            if len(near):
                value = exact(q[i], x[near])
                best = np.lexsort((ids[near], -value))
                best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])[:k]]
                out["query_id"].append(int(queries[0][row]))
                out["mark"].append(int(queries[1][row]))
                out["ids"].append(ids[near][best].tobytes())
                out["scores"].append(value[best].tobytes())
    return pa.table(out, LISTS_ARROW)


def merged(lists: DataFrame, k: int, score_type: str, marked: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score (and mark): the ``k`` best of all blocks' lists; an id found twice counts once."""
    kind, arrow = (np.int64, pa.int64()) if score_type == "long" else (np.float64, pa.float64())

    def merge(table: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        scores = np.frombuffer(b"".join(table.column("scores").to_pylist()), kind)
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)
        best = order[np.sort(first)[:k]]
        n = len(best)
        columns = {"query_id": pa.array([table.column("query_id")[0].as_py()] * n, pa.int64()), "rank": pa.array(range(1, n + 1), pa.int32()), "vec_id": pa.array(ids[best]), "score": pa.array(scores[best], arrow)}
        if marked:
            columns["mark"] = pa.array([table.column("mark")[0].as_py()] * n, pa.int64())
        return pa.table(columns)

    return lists.groupBy("query_id", "mark").applyInArrow(merge, f"query_id long, rank int, vec_id long, score {score_type}" + ", mark long" * marked)
