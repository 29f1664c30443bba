"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

Darts are thrown over the plane (weight of an element) x (rank).  The plane is cut into unit cells; the
number of darts in a cell, and each dart's rank, height and coordinate, are hashes of element and cell, so
that every document sees the same darts.  A document keeps those below its elements' weights and below a
rank that leaves about ``k ln k + 2k`` of them, and for each of ``k`` coordinates the earliest is its
signature.  Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Documents with equal shingle sets are one node from the start.  The nodes of a band are compared with one
center only, on whole shingle sets, and merged into components.  Pairs around a center that are still in
different components are compared as well, but only those that can be linked at all given what both share
with the center: no link that a band can show is lost, and no group is expanded into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import Remember, byte_texts, in_parts, materialize, mix, release, rolling, split_words, window_starts, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8**5)**28 < 2e-5.
BANDS, ROWS = 28, 5
BASE = 0x2545F4914F6CDD1D
#: Bytes of text worked on at once: a text of n words throws some 1,000 darts whatever n is.
CHUNK_BYTES = 1 << 20
#: Cells in which darts are thrown at once, about 100 bytes each; a longer text's elements are taken in turn.
DART_CELLS = 1 << 18
#: Pairs that a node's shingle set meets in one part; it is sent once for each part.
PART_PAIRS = 128
_COMPARED = "a long, b long, a_mark long, b_mark long, na int, nb int, common int"
#: Cumulative probabilities of 0, 1, 2, ... darts in a cell of area one.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
_SKETCH = pa.schema([("doc_id", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, of: np.ndarray, sets: int, k: int) -> np.ndarray:
    """A (sets, k) array of the earliest dart of each coordinate, from elements of weight ``weights`` in set ``of``.

    Sets without elements keep the largest value everywhere.
    """
    never = np.uint64((1 << 64) - 1)
    out = np.full((sets, k), never, np.uint64)
    total = np.bincount(of, weights, sets)
    wanted = k * math.log(k) + 2 * k
    pending = np.flatnonzero(total > 0)
    while len(pending):
        limit = np.zeros(sets)
        limit[pending] = wanted / total[pending]
        mine = np.flatnonzero(limit[of] > 0)
        ends = np.cumsum(np.ceil(limit[of[mine]]).astype(np.int64) * np.ceil(weights[mine]).astype(np.int64))
        start = 0
        while start < len(mine):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + DART_CELLS, side="right")))
            some = mine[start:stop]
            _throw(elements[some], limit[of[some]], weights[some], of[some], k, out)
            start = stop
        pending = pending[(out[pending] == never).any(axis=1)]
        wanted *= 2
    return out


def _throw(el: np.ndarray, top: np.ndarray, high: np.ndarray, own: np.ndarray, k: int, out: np.ndarray) -> None:
    """Throw the darts of some elements, below rank ``top`` and height ``high``, and keep the earliest in ``out``."""
    ranks, heights = np.ceil(top).astype(np.int64), np.ceil(high).astype(np.int64)
    cells = ranks * heights
    at = np.repeat(np.arange(len(el)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    rank, height = cell // heights[at], cell % heights[at]
    seed = mix(el[at] ^ mix(rank.astype(np.uint64) << np.uint64(32) | height.astype(np.uint64), 1))
    darts = np.searchsorted(_POISSON, _unit(seed), side="right")
    at, rank, height, seed = (np.repeat(x, darts) for x in (at, rank, height, seed))
    number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
    seed = mix(seed + number.astype(np.uint64), 2)
    r = rank + _unit(seed)
    keep = r < top[at]
    if high.max(initial=0) != 1 or high.min(initial=1) != 1:
        keep &= height + _unit(mix(seed, 3)) < high[at]
    at, seed, r = at[keep], seed[keep], r[keep]
    place = own[at] * k + (mix(seed, 4) % np.uint64(k)).astype(np.int64)
    # earliest rank first: 44 bits of rank, 20 of the dart's own hash
    value = (r * (1 << 30)).astype(np.uint64) << np.uint64(20) | seed >> np.uint64(44)
    np.minimum.at(out.reshape(-1), place, value)


def shingle_sets(texts: list[bytes], remember: Remember, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and the text each belongs to, ordered by both; a shorter text is one shingle."""
    words, counts = split_words(texts)
    hashes = word_hashes(words, remember)
    of, at, _ = window_starts(counts, width)
    found, short = mix(rolling(hashes, width, BASE))[at], np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin = np.cumsum(counts) - counts
        whole = [mix(rolling(hashes[begin[i] : begin[i] + counts[i]], int(counts[i]), BASE), int(counts[i]))[0] for i in short]
        found, of = np.concatenate((found, np.array(whole, np.uint64))), np.concatenate((of, short))
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], of[new]


def _sketch(width: int, bands: int, rows: int):
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember = Remember(xxhash.xxh3_64_intdigest)

        def sketches(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n = part.num_rows
            found, of = shingle_sets(byte_texts(part), remember, width)
            signature = dart_signatures(found, np.ones(len(found)), of, n, bands * rows)
            sums = np.zeros((2, n), np.uint64)
            for i in (0, 1):
                np.add.at(sums[i], of, mix(found, 11 + i))
            keys = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], n, axis=0)
            for j in range(rows):
                keys = mix(keys ^ signature[:, j::rows], 21)
            offsets = np.arange(0, n * bands + 1, bands, dtype=np.int32)
            counts = np.bincount(of, minlength=n).astype(np.int32)
            columns = [part.column("doc_id"), *(pa.array(s.view(np.int64)) for s in sums), pa.array(counts), pa.ListArray.from_arrays(offsets, keys.reshape(-1).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=_SKETCH)

        yield from in_parts(batches, "text", CHUNK_BYTES, sketches)

    return sketched


def _sets(width: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember = Remember(xxhash.xxh3_64_intdigest)

        def sets(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found, of = shingle_sets(byte_texts(part), remember, width)
            ends = np.cumsum(np.bincount(of, minlength=part.num_rows))
            data = [found[a:b].tobytes() for a, b in zip(ends - np.diff(ends, prepend=0), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], ["node", "shingles"])

        yield from in_parts(batches, "text", CHUNK_BYTES, sets)

    return packed


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of shingles that both texts of a pair have."""

    def compared(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("a", "b", "a_mark", "b_mark", "na", "nb")), pa.array(common, pa.int32())], ["a", "b", "a_mark", "b_mark", "na", "nb", "common"])

    yield from in_parts(batches, "x", CHUNK_BYTES, compared)


def _remainder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of a that b lacks."""

    def remaining(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rest = [np.setdiff1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).view(np.int64) for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)]
        offsets = np.cumsum([0, *map(len, rest)]).astype(np.int32)
        flat = np.concatenate(rest) if rest else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("a", "b", "a_mark", "b_mark")), pa.ListArray.from_arrays(offsets, flat)], ["a", "b", "a_mark", "b_mark", "rest"])

    yield from in_parts(batches, "x", CHUNK_BYTES, remaining)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of (a, b), by alternating large and small stars.

    Every round is written to the shared folder; a round needs one grouping with partial sums and one join.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(edges.select("b", "a"))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
        linked = both.join(least, "u").select("u", "v", "m")
        if large:
            out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.where("u <> m").select("u", "m"))
        made = materialize(out.distinct(), "star")
        release(least)
        return made

    def digest(edges: DataFrame):
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = materialize(edges.where("a <> b").distinct(), "edges")
    seen = None
    while seen != (now := digest(edges)):
        seen = now
        large = star(edges, True)
        release(edges)
        edges = star(large, False)
        release(large)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b", "b")).distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id for every row of (doc_id, text): the near-duplicate class it belongs to.

    Two documents are linked if the Jaccard similarity of their sets of ``width`` consecutive words is at
    least ``similarity``; a class is a connected component and has the smallest doc_id as its id.  A text
    of fewer words is one shingle.  Texts without words (null, empty, white space) are alone in a class of
    their own.  Rows with a null doc_id take no part and have a null class_id.  Rows that repeat a doc_id
    are the same document.  Other columns are left out; an empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialize(base.mapInArrow(_sketch(width, bands, rows), "doc_id long, d0 long, d1 long, n int, bands array<long>"), "sketches")
    used = sketches.where("n > 0 and doc_id is not null")
    nodes = materialize(used.groupBy("d0", "d1", "n").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "nodes")
    stars = materialize(_stars(nodes), "stars")
    sets = materialize(_shingles(base, stars, width), "shingles")
    measured = materialize(_pairs_with_sets(stars.select(F.col("node").alias("a"), F.col("center").alias("b")), sets).mapInArrow(_compare, _COMPARED), "measured")
    alike = F.col("common") >= similarity * (F.col("na") + F.col("nb") - F.col("common"))
    edges = materialize(measured.where(alike).select("a", "b"), "links")
    merged = materialize(components(edges), "components")

    candidates = materialize(_left_over(measured, merged, sets, similarity), "left-over")
    more = _pairs_with_sets(candidates, sets).mapInArrow(_compare, _COMPARED).where(alike).select("a", "b")
    more = materialize(more, "more-links")
    release(measured, sets, stars, candidates)
    if not more.isEmpty():
        merged = materialize(components(edges.union(more)), "components")

    classes = nodes.select("d0", "d1", "n", "node").join(merged, "node", "left").select("d0", "d1", "n", F.coalesce("component", "node").alias("class_id"))
    classes = materialize(classes, "classes")
    out = used.select("doc_id", "d0", "d1", "n").join(classes, ["d0", "d1", "n"]).select("doc_id", "class_id")
    alone = sketches.where("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return out.unionByName(alone)


def _stars(nodes: DataFrame) -> DataFrame:
    """Distinct (node, center): the nodes of every band that several share, with the band's center.

    The center is the node that shares most in all its bands, which in a group of edited copies tends to be
    the text they were made from; of equals it is the smallest.
    """
    banded = nodes.select("node", F.explode("bands").alias("band"))
    sizes = materialize(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "bands")
    members = materialize(banded.join(sizes, "band").select("band", "node", "size"), "members")
    shared = materialize(members.groupBy("node").agg(F.sum("size").alias("shared")), "shared")
    center = members.join(shared, "node").groupBy("band").agg(F.min(F.struct((-F.col("shared")).alias("s"), "node")).alias("c"))
    center = materialize(center.select("band", F.col("c.node").alias("center")), "centers")
    return members.join(center, "band").where("node <> center").select("node", "center").distinct()


def _shingles(base: DataFrame, stars: DataFrame, width: int) -> DataFrame:
    """Distinct (node, mark, shingles) for all nodes of the stars, from the whole texts.

    However often a document's row repeats, its set is there once; texts of one doc_id that differ have sets
    of their own, which ``mark`` tells apart.
    """
    involved = stars.select(F.explode(F.array("node", "center")).alias("doc_id")).distinct()
    sets = base.join(involved.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets(width), "node long, shingles binary")
    return sets.where("octet_length(shingles) > 0").withColumn("mark", F.xxhash64("shingles")).dropDuplicates(["node", "mark"])


def _pairs_with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, a_mark, b_mark, na, nb, x, y: pairs of (a, b) with both shingle sets, their marks and sizes."""
    both = _with_sets(_with_sets(pairs.select("a", "b"), pairs, sets, "a", "b", "x"), pairs, sets, "b", "a", "y")
    return both.select("a", "b", "a_mark", "b_mark", (F.octet_length("x") / 8).cast("int").alias("na"), (F.octet_length("y") / 8).cast("int").alias("nb"), "x", "y")


def _with_sets(rows: DataFrame, pairs: DataFrame, sets: DataFrame, node: str, other: str, name: str, keep_part: bool = False) -> DataFrame:
    """``rows`` with ``name``, the shingle set of ``node``, and its mark.

    A node of many pairs meets them in as many parts as keep about ``PART_PAIRS`` in each, dealt by the other node: its
    set is sent to every part.  Most nodes have one part.
    """
    parts = pairs.groupBy(node).agg(F.ceil(F.count("*") / PART_PAIRS).cast("int").alias("parts")).where("parts > 1")
    of = lambda t: t.join(parts, node, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = of(rows).withColumn("part", F.pmod(F.xxhash64(other), "parts").cast("int")).drop("parts")
    own = of(sets.select(F.col("node").alias(node), F.col("mark").alias(f"{node}_mark"), F.col("shingles").alias(name)))
    sent = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = dealt.join(sent, [node, "part"])
    return both if keep_part else both.drop("part")


def _left_over(measured: DataFrame, merged: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs around one center, of different components, that can still be linked: distinct (a, b).

    Let x and y have n_x and n_y shingles and share c_x and c_y of them with their center.  A link needs
    ``t (n_x + n_y)`` common shingles, t = s / (1 + s), of which the center has at most min(c_x, c_y).
    Either that is enough by itself, which only few lengths n_y allow; or x and y share shingles that the
    center lacks, at least ``s n_x - c_x`` and at least ``s n_y - c_y`` of them.  Then they agree in one
    of the rarest ``r - needed + 1`` of the r shingles each has beside the center.  All this is about sets:
    a doc_id whose texts differ is as many nodes, or centers, as it has sets.
    """
    of = lambda t, name: t.select(F.col("node").alias(name), F.col("component").alias(f"{name}_of"))
    rows = measured.join(of(merged, "a"), "a", "left").join(of(merged, "b"), "b", "left")
    rows = rows.select(F.col("b").alias("center"), F.col("b_mark").alias("c_mark"), F.col("a").alias("node"), F.col("a_mark").alias("mark"), F.col("na").alias("n"), "common", F.coalesce("a_of", "a").alias("label"), F.coalesce("b_of", "b").alias("home"))
    open_ = rows.groupBy("center").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("home").alias("z"), F.count("*").alias("m")).where("m > 1 and (x <> y or x <> z)").select("center")
    rows = materialize(rows.join(open_, "center", "left_semi"), "open-stars")

    needed = F.greatest(F.lit(1), F.ceil(F.lit(similarity) * F.col("n") - F.col("common") - F.lit(1e-6))).cast("int")
    wanted = rows.withColumn("prefix", F.col("n") - F.col("common") - needed + 1).where("prefix > 0")
    beside = materialize(wanted.select(F.col("node").alias("a"), F.col("center").alias("b")).distinct(), "beside-pairs")
    rest = _pairs_with_sets(beside, sets).mapInArrow(_remainder, "a long, b long, a_mark long, b_mark long, rest array<long>")
    own = rest.select(F.col("b").alias("center"), F.col("b_mark").alias("c_mark"), F.col("a").alias("node"), F.col("a_mark").alias("mark"), F.explode("rest").alias("shingle"))
    own = materialize(own, "beside-center")
    often = materialize(own.groupBy("center", "c_mark", "shingle").agg(F.count("*").alias("df")).where("df > 1"), "beside-often")
    ranked = own.join(often, ["center", "c_mark", "shingle"], "left").withColumn("i", F.row_number().over(Window.partitionBy("center", "c_mark", "node", "mark").orderBy(F.coalesce("df", F.lit(1)), "shingle")))
    kept = ranked.where("df is not null").join(wanted.select("center", "c_mark", "node", "mark", "n", "label", "prefix"), ["center", "c_mark", "node", "mark"]).where("i <= prefix").select("center", "c_mark", "shingle", "node", "n", "label")
    kept = materialize(kept, "prefixes")
    other = kept.select("center", "c_mark", "shingle", *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "label")])
    fits = f"label <> o_label and least(n, o_n) >= {similarity} * greatest(n, o_n)"
    shared = kept.join(other, ["center", "c_mark", "shingle"]).where(f"node < o_node and {fits}").select(F.col("node").alias("a"), F.col("o_node").alias("b"))

    t = similarity / (1 + similarity)
    lengths = F.sequence(F.ceil(F.lit(similarity) * F.col("n") - 1e-6).cast("int"), F.floor(F.col("common") / t - F.col("n") + 1e-6).cast("int"))
    short = rows.where(F.ceil(F.lit(similarity) * F.col("n") - 1e-6) <= F.floor(F.col("common") / t - F.col("n") + 1e-6))
    short = short.where(F.col("label") != F.col("home")).select("center", "c_mark", F.col("node").alias("o_node"), F.col("n").alias("o_n"), F.col("label").alias("o_label"), F.explode(lengths).alias("n"))
    inside = rows.join(short, ["center", "c_mark", "n"]).where((F.col("node") != F.col("o_node")) & (F.col("common") + 1e-6 >= t * (F.col("n") + F.col("o_n")))).where(fits)
    inside = inside.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))
    return shared.union(inside).distinct()
