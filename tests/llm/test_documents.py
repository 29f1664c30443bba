"""Operators on documents against brute force, with awkward rows."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tallyfield.llm import common, minhash, mixing, packing, quality, sharding, substring, token_counts
from tallyfield.llm.common import Remember
from tests.llm.edge import SCHEMA, corpus, frame, words

N = -(1 << 63)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(nothing):
    assert substring.remove_repeats(nothing).count() == 0
    assert minhash.near_duplicates(nothing).count() == 0
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0
    assert packing.pack_documents(nothing).count() == 0
    assert sharding.shard_by_bytes(nothing).count() == 0
    assert token_counts.token_counts(nothing).count() == 0
    model = quality.train(nothing, nothing.selectExpr("doc_id", "1 as quality"))
    assert quality.score(nothing, model).count() == 0


def brute_substring(rows, width=20):
    first = {}
    for d, t, _ in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            k, at = tuple(w[i : i + width]), (N if d is None else d, i)
            first[k] = min(first.get(k, at), at)
    out = []
    for d, t, _ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (N if d is None else d, i):
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substring(docs, rows):
    got = substring.remove_repeats(docs)
    assert {"lang", "source", "n_chars", "text"} < set(got.columns)
    found = [tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute_substring(rows)))
    assert sum(r[2] for r in found) > 300


def test_substring_in_small_chunks(docs, rows, monkeypatch):
    """Many chunks and many buckets, so that repeats are found across them."""
    monkeypatch.setattr(substring, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 1000)
    pieces = docs.repartition(17)
    packed = pieces.selectExpr("doc_id", "text", "xxhash64(text) text_hash").mapInArrow(substring._pack_windows(20, 50), substring._PACKED)
    assert packed.select("chunk").distinct().count() > 20 and packed.select("bucket").distinct().count() == 50
    found = [tuple(r) for r in substring.remove_repeats(pieces).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute_substring(rows)))


def test_windows_of_one_hash_are_told_apart():
    """Equal 64-bit values whose further bits differ are different windows."""
    r = np.random.default_rng(0)
    hashes, tags = r.integers(0, 5, 400).astype(np.uint64), r.integers(0, 4, 400).astype(np.uint16)
    ids, starts = r.integers(0, 9, 400), r.integers(0, 30, 400)
    first = {}
    for h, t, at in zip(hashes.tolist(), tags.tolist(), zip(ids.tolist(), starts.tolist(), strict=True), strict=True):
        first[h, t] = min(first.get((h, t), at), at)
    expected = [first[h, t] < at for h, t, at in zip(hashes.tolist(), tags.tolist(), zip(ids.tolist(), starts.tolist(), strict=True), strict=True)]
    assert substring._repeats(hashes, tags, ids, starts).tolist() == expected


def test_both_hashes_follow_the_words():
    r = np.random.default_rng(1)
    for width in (1, 2, 3, 20):
        words = [b"w%d" % i for i in r.integers(0, 2, 3000)]
        both, counts = substring._word_hashes([b" ".join(words), b""], Remember(substring._two_hashes))
        assert counts.tolist() == [3000, 0]
        for h in substring._windows(both, width):
            by = {}
            for i, x in enumerate(h.tolist()):
                by.setdefault(x, set()).add(tuple(words[i : i + width]))
            assert len(h) == 3001 - width and all(len(x) == 1 for x in by.values())
            assert len(by) == len({tuple(words[i : i + width]) for i in range(len(h))})


def brute_classes(rows, similarity=0.8, width=5):
    sets = collections.defaultdict(set)
    for d, t, _ in rows:
        w = words(t)
        if d is not None and w:
            sets[d] |= {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}
    parent = {d: d for d, _, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in parent}


def test_near_duplicates(docs, rows):
    got = [tuple(r) for r in minhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    expected = brute_classes(rows)
    assert {d: c for d, c in got if d is not None} == expected
    assert all(c is None for d, c in got if d is None)
    assert collections.Counter(expected.values()).most_common(1)[0][1] >= 11


@pytest.mark.parametrize("part", [minhash.PART_PAIRS, 5])
def test_near_duplicates_of_a_group_around_the_threshold(spark, monkeypatch, part):
    """Edited copies whose pairs lie on both sides of 0.8: links that no center shows must be found too, in one part or many."""
    import random

    monkeypatch.setattr(minhash, "PART_PAIRS", part)
    r = random.Random(3)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for d in range(120):
        text = list(base)
        for _ in range(r.randint(0, 9)):
            text[r.randrange(150)] = f"e{r.randrange(40)}"
        rows.append((d, " ".join(text), "s"))
    got = {a: b for a, b in minhash.near_duplicates(frame(spark, rows)).collect()}
    expected = brute_classes(rows)
    assert got == expected and len(set(expected.values())) > 3


def test_near_duplicates_whose_rows_repeat(spark):
    """Families of two, far from the one center: their link shows only beside it, however often rows repeat."""
    base = [f"t{i}" for i in range(150)]
    rows = [(0, " ".join(base), "s")]
    for d in range(40):
        for e in range(2):
            text = list(base)
            for at in range(10, 60, 7):
                text[at] = f"family{d}"
            text[100 + 4 * e] = f"own{d}-{e}"
            rows.append((1 + 2 * d + e, " ".join(text), "s"))
    once, twice = (dict(tuple(x) for x in minhash.near_duplicates(frame(spark, rows * n), bands=1, rows=1).collect()) for n in (1, 2))
    assert once == twice and len(set(once.values())) < 81


def test_pairs_of_a_hot_center_are_dealt_over_parts(spark, monkeypatch):
    """A center of many pairs, and a node of many: every pair comes once, with both sets, and no part has many."""
    monkeypatch.setattr(minhash, "PART_PAIRS", 8)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 9))) for i in range(100)], "doc_id long, text string")
    stars = spark.createDataFrame([(i, 0) for i in range(1, 100)] + [(99, i) for i in range(1, 60)], "node long, center long")
    pairs = stars.selectExpr("node a", "center b")
    sets = minhash._shingles(docs, stars, 5)
    got = minhash._pairs_with_sets(pairs, sets).collect()
    held = {r["node"]: bytes(r["shingles"]) for r in sets.collect()}
    assert sorted((r["a"], r["b"]) for r in got) == sorted((r["a"], r["b"]) for r in pairs.collect())
    assert all((bytes(r["x"]), bytes(r["y"]), r["na"], r["nb"]) == (held[r["a"]], held[r["b"]], 5, 5) for r in got)
    dealt = minhash._with_sets(pairs, pairs, sets, "b", "a", "y", keep_part=True).groupBy("b", "part").count()
    assert dealt.agg({"count": "max"}).first()[0] <= 20 and dealt.where("b = 0").count() == 13


def test_one_set_for_each_text_of_a_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "a  b c d e f"), (1, "g h"), (2, "a b c d e f"), (2, ""), (3, "x")], "doc_id long, text string")
    stars = spark.createDataFrame([(2, 1)], "node long, center long")
    sets = minhash._shingles(docs, stars, 5)
    pairs = minhash._pairs_with_sets(stars.selectExpr("node a", "center b"), sets)
    assert sorted((r["node"], len(r["shingles"]) // 8) for r in sets.collect()) == [(1, 1), (1, 2), (2, 2)]
    assert sorted((r["a"], r["b"], r["na"], r["nb"]) for r in pairs.collect()) == [(2, 1, 2, 1), (2, 1, 2, 2)]


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    elements = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    both = minhash.dart_signatures(np.concatenate((elements, elements)), np.concatenate((a, b)), np.repeat([0, 1], 300), 2, 2000)
    assert abs((both[0] == both[1]).mean() - true) < 0.05
    alone = minhash.dart_signatures(elements, a, np.zeros(300, np.int64), 1, 2000)
    assert (alone[0] == both[0]).all()


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode("utf-32-be")) + [k for k in sizes if k is None]
    weight = {k: weights[i % 3] for i, k in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while True:
        total = sum(weight[k] for k in open_)
        over = [k for k in open_ if left * weight[k] / total > most * sizes[k]]
        if not over:
            return target | {k: left * weight[k] / total for k in open_}
        for k in over:
            target[k] = most * sizes[k]
            open_.discard(k)
            left -= target[k]


def close_to(taken, target, sizes):
    """Within 1 % of the target where the documents allow a tenth of that; else within the longest document."""
    whole, longest = int(target // max(1, sum(sizes))), max(sizes)
    sums = 1
    for n in sizes:
        sums |= sums << n
    rest = round(target - whole * sum(sizes))
    slack = int(0.001 * target) + 1
    allowed = sums >> max(0, rest - slack) & ((1 << (2 * slack + 1)) - 1)
    return abs(taken - target) <= (max(0.01 * target, 1) if allowed else longest + 1)


def test_mixing(docs, rows):
    got = [r.asDict() for r in mixing.mix_sources(docs).collect()]
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    expected, taken, per_source = brute_targets(sizes), collections.Counter(), collections.defaultdict(list)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], expected[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
        per_source[r["source"]].append(r["size"])
    for s in sizes:
        assert close_to(taken[s], expected[s], per_source[s])
    again = [tuple(r) for r in mixing.mix_sources(docs.repartition(7)).collect()]
    assert sorted(map(str, again)) == sorted(str(tuple(r.values())) for r in got)


def test_mixed_documents(docs):
    drawn = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        drawn[r["doc_id"]] += r["copies"]
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in rows.select("doc_id").collect()) == +drawn


def test_pivot_keeps_words_and_expectations():
    rng = np.random.default_rng(2)
    fraction, size = rng.uniform(0.05, 0.95, 40), rng.integers(1, 90, 40).astype(float)
    runs = np.zeros(40)
    for _ in range(3000):
        out, held = mixing.pivot(fraction, size, rng.random(40))
        assert abs((out * size).sum() - (fraction * size).sum()) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(out) if i != held)
        runs += out
    assert np.abs(runs / 3000 - fraction).max() < 0.06


def test_what_is_left_over_is_short():
    """Settling keeps the words of all and nearly, at equal fractions, the expectations."""
    rng = np.random.default_rng(3)
    size = np.append(rng.integers(5, 40, 200), [900, 700]).astype(float)
    fraction, runs = np.full(202, 0.4), np.zeros(202)
    for _ in range(4000):
        dice = rng.random(202)
        out, held = mixing.pivot(fraction, size, dice)
        if held >= 0:
            out, held = mixing.settle(out, size, held, dice)
        assert abs((out * size).sum() - (fraction * size).sum()) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(out) if i != held) and (held < 0 or 0 < out[held] < 1 and size[held] < 41)
        runs += out
    off = np.abs(runs / 4000 - fraction)
    assert off.max() < 0.1 and off.mean() < 0.03  # the shortest fill what is left and keep theirs less closely


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    expected = collections.Counter()
    for d, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected[d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack_documents(docs, with_ids=True).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    assert all(zlib.crc32(np.array(r["ids"], np.uint32).tobytes()) == r["ids_crc32"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 4096
    assert len(by) == packing.bins_needed(np.array([r["length"] for r in got]), 4096)


def test_packing_over_exchanging_groups(spark):
    """Groups with gaps pass pieces on, and nothing is lost on the way."""
    lengths = np.random.default_rng(4).integers(1400, 2700, 4000)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "uid long, length long")
    got = packing.pack(pieces, group_pieces=50).collect()
    assert sorted(r["uid"] for r in got) == list(range(4000))
    used = collections.Counter()
    for r in got:
        used[r["sequence_id"]] += int(lengths[r["uid"]])
    assert max(used.values()) <= 4096
    alone = packing.best_fit_decreasing(lengths, 4096).max() + 1
    assert packing.bins_needed(lengths, 4096) <= len(used) <= 1.06 * alone


def test_lower_bounds_hold():
    """No bound exceeds the best packing, found by search for small cases."""

    def best(sizes, room):
        n, least = len(sizes), [len(sizes)]

        def place(i, bins):
            if len(bins) >= least[0]:
                return
            if i == n:
                least[0] = len(bins)
                return
            for k in {b: j for j, b in enumerate(bins)}.values():
                if bins[k] + sizes[i] <= room:
                    bins[k] += sizes[i]
                    place(i + 1, bins)
                    bins[k] -= sizes[i]
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        return least[0]

    rng = np.random.default_rng(0)
    met = 0
    for _ in range(60):
        sizes = np.sort(rng.integers(1, 21, 9))[::-1]
        bound, true = packing.bins_needed(sizes, 20), best(sizes.tolist(), 20)
        assert bound <= true <= packing.best_fit_decreasing(sizes, 20).max() + 1
        met += bound == true
    assert met > 50


def test_sharding(docs, rows):
    got = sharding.shard_by_bytes(docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(str((d, size(t), crc(t))) for d, t, _ in rows)
    slots, total = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(size(t) for _, t, _ in rows)
    assert max(total.values()) - min(total[s] for s in range(4)) <= 2 * longest


def test_sharding_keeps_equal_texts_together_and_splits_what_is_too_much(spark):
    rows = [(i, f"text {i} " + "y" * (i % 50), "s") for i in range(4000)] + [(5000 + i, "one text that many rows hold", "s") for i in range(4000)] + [(9001 + i, "pair", "s") for i in range(2)]
    got = sharding.shard_by_bytes(frame(spark, rows), 8).collect()
    total = collections.Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    assert len(total) == 8 and max(total.values()) < 1.02 * min(total.values())
    assert len({r["shard"] for r in got if r["doc_id"] >= 9001}) == 1
    again = sharding.shard_by_bytes(frame(spark, rows).repartition(5), 8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def brute_tokens(word, vocabulary):
    """All segmentations, by recursion without sharing."""
    if not word:
        return 0.0, 0

    best = None
    for end in range(1, len(word) + 1):
        head = word[:end] if best is None else word[:end]
        rest = brute_tokens(word[:-end], vocabulary)
        piece = word[-end:]
        score, n = vocabulary.scores.get(piece), 1
        if score is None:
            if end > 1:
                continue
            score, n = vocabulary.unknown, len(piece.encode())
        option = (rest[0] + score, -(rest[1] + n))
        best = option if best is None or option > best else best
        assert head
    return best[0], -best[1]


def test_token_counts(docs, rows):
    vocabulary = token_counts.zipf_vocabulary(token_counts.default_model())
    got = collections.Counter(tuple(r) for r in token_counts.token_counts(docs).collect())
    trie = token_counts.PretokenTrie(vocabulary)
    expected = collections.Counter((d, len(words(t)), sum(trie.tokens("▁" + w) for w in words(t))) for d, t, _ in rows)
    assert got == expected
    distinct = {w for _, t, _ in rows for w in words(t) if len(w) < 11}
    for w in distinct:
        assert trie.tokens("▁" + w) == brute_tokens("▁" + w, vocabulary)[1], w


def test_trie_that_starts_again(monkeypatch):
    vocabulary = token_counts.zipf_vocabulary(token_counts.default_model())
    whole, small = token_counts.PretokenTrie(vocabulary), token_counts.PretokenTrie(vocabulary)
    tokens = [f"▁word{i}ing" for i in range(300)]
    expected = [whole.tokens(t) for t in tokens]
    monkeypatch.setattr(token_counts, "TRIE_NODES", 20)
    assert [small.tokens(t) for t in tokens] == expected


def test_quality_on_held_out_rows(spark):
    from tallyfield.llm.queries import op5_quality

    scored = op5_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = scored.join(labels, "doc_id").where("held_out").selectExpr("avg(int(predicted = quality)) a", "count(*) n").first()
    assert out["n"] > 500 and out["a"] > 0.98


def test_quality_edges(spark, docs, rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (None, 1), (4, None), (999999, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert set(scored.columns) == set(docs.columns)
    by = scored.select("text", "score").collect()
    assert len(by) == len(rows) and all(0 <= r["score"] <= 1 for r in by)
    assert len({r["score"] for r in by if not words(r["text"])}) == 1
    texts = collections.defaultdict(set)
    for r in by:
        texts[r["text"]].add(r["score"])
    assert all(len(s) == 1 for s in texts.values())
    assert hashlib.sha256(model.weights.tobytes()).digest() == hashlib.sha256(quality.train(docs.repartition(5), labels).weights.tobytes()).digest()


def test_a_text_that_a_shard_holds_stays_whole(spark):
    """Copies of 0.9 shards' bytes share one shard; those of 1.5 shards are split; sizes stay equal."""
    size = 30
    text = lambda i: f"text {i} ".ljust(size - 1, "y")
    other = [(i, text(i), "s") for i in range(5600)]
    rows = other + [(10_000 + i, "a".ljust(size - 1, "a"), "s") for i in range(900)] + [(20_000 + i, "b".ljust(size - 1, "b"), "s") for i in range(1500)]
    got = sharding.shard_by_bytes(frame(spark, rows).repartition(5), 8).collect()
    total, shards, slots = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        total[r["shard"]] += r["size"]
        shards[r["doc_id"] // 10_000].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert len(shards[1]) == 1 and len(shards[2]) > 1
    assert len(total) == 8 and max(total.values()) < 1.02 * min(total.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mixes_meet_their_targets_closely(spark, small):
    """Even where some documents are very long."""
    r = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 3}") for i, n in enumerate(np.append(r.integers(20, 200, 3000), [4000, 5000, 6000] * 3))]
    got = mixing.mix_sources(frame(spark, rows).repartition(3)).collect()
    taken, target = collections.Counter(), {}
    for x in got:
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    assert all(abs(taken[s] - t) < 0.005 * t for s, t in target.items())


@pytest.mark.parametrize("n", [12, 50, 400])
def test_small_sources_meet_their_targets(spark, n):
    """Sources of few documents with very unequal lengths, some of one document only."""
    r = np.random.default_rng(n)
    rows = [(1000 * s + i, " ".join(["w"] * int(k)), f"s{s}") for s in range(6) for i, k in enumerate(np.append(r.integers(3, 60, n - 2), [1400, 900]))]
    taken, target, sizes = collections.Counter(), {}, collections.defaultdict(list)
    for x in mixing.mix_sources(frame(spark, rows)).collect():
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
        sizes[x["source"]].append(x["size"])
    assert all(close_to(taken[s], t, sizes[s]) for s, t in target.items())


def test_levels_of_groups_meet_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    r = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(k)), f"s{i % 2}") for i, k in enumerate(r.integers(1, 90, 1500))]
    taken, target = collections.Counter(), {}
    for x in mixing.mix_sources(frame(spark, rows)).collect():
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    assert all(abs(taken[s] - t) < 0.01 * t for s, t in target.items())


def _peak(work) -> float:
    """MB of arrays and objects that ``work`` holds at most, beyond what was there."""
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_many_short_texts_throw_their_darts_in_turn(monkeypatch):
    r = np.random.default_rng(0)
    elements, of = r.integers(0, 1 << 63, 30_000).astype(np.uint64), np.sort(r.integers(0, 10_000, 30_000))
    got = []
    assert _peak(lambda: got.append(minhash.dart_signatures(elements, np.ones(30_000), of, 10_000, 140))) < 120
    monkeypatch.setattr(minhash, "DART_CELLS", 1 << 30)
    some = of < 200
    assert (got[0][:200] == minhash.dart_signatures(elements[some], np.ones(some.sum()), of[some], 200, 140)).all()


def test_one_very_long_word_needs_no_nodes():
    vocabulary = token_counts.Vocabulary({c: -3.0 for c in "abc▁"} | {"ab": -4.0, "abc": -4.5, "ca": -5.0, "cabca": -7.0}, -20.0)
    trie, r = token_counts.PretokenTrie(vocabulary), random.Random(2)
    word = "".join(r.choices("abcé", k=2000))
    plain = token_counts.PretokenTrie(vocabulary)
    for depth, n in ((5, 900), (256, 2000), (3, 40)):
        token_counts_depth, token_counts.TRIE_DEPTH = token_counts.TRIE_DEPTH, depth
        try:
            got = token_counts.PretokenTrie(vocabulary).tokens(word[:n])
            token_counts.TRIE_DEPTH = 10**9
            assert got == plain.tokens(word[:n])
        finally:
            token_counts.TRIE_DEPTH = token_counts_depth
    assert _peak(lambda: trie.tokens(word * 500)) < 20 and len(trie.best) <= token_counts.TRIE_DEPTH + 1


def test_long_words_are_not_all_remembered():
    remember = common.Remember(len)
    assert _peak(lambda: [remember[bytes(10_000) + i.to_bytes(4, "big")] for i in range(20_000)]) < 2 * common.REMEMBERED_BYTES / 1e6
    assert remember.held <= common.REMEMBERED_BYTES
    assert remember[b"x" * common.REMEMBERED_BYTES] == common.REMEMBERED_BYTES and b"x" * common.REMEMBERED_BYTES not in remember
