"""Each stage of the corpus pipeline on its own input, against brute force; and the queries that have SQL."""

import collections
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tallyfield.llm import mixing, oracles, packing, quality, queries
from tallyfield.llm.common import Remember
from tests.duck import compared, views
from tests.llm.edge import corpus, frame, words
from tests.llm.test_documents import brute_classes, brute_substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    """Awkward rows without ids that repeat: in a table of documents an id is one row's."""
    seen, out = set(), []
    for d, t, s in corpus():
        if d is None or d not in seen:
            out.append((d, t, s))
            seen.add(d)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    labels = [(d, int(d % 3 > 0), 0) for d in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top)


def kept(df):
    return sorted(str((r["doc_id"], r["text"], r["source"])) for r in df.collect())


def test_the_stages_and_their_order():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "repeated passages", "source mix", "packing"]


def test_quality_stage_keeps_what_scores_enough_by_itself(spark, docs, rows, sf_dir):
    got = STAGES["quality classifier"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).weights
    good = []
    for d, t, s in rows:
        grams, counts = quality.ngram_buckets([(t or "").encode()], Remember(quality._two_hashes))
        dot = quality.SCALE * sum(float(weights[g]) for gram in grams for g in gram) / max(1, 4 * int(counts[0])) + weights[0]
        if 1 / (1 + np.exp(-dot)) >= 0.7:
            good.append((d, t, s))
    assert kept(got) == sorted(map(str, good))


def test_near_duplicate_stage_keeps_one_of_each_class(spark, docs, rows, sf_dir):
    got = STAGES["near duplicates"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    classes = brute_classes(rows)
    assert kept(got) == sorted(str(r) for r in rows if r[0] is None or classes[r[0]] == r[0])


def test_passage_stage_keeps_the_first_of_each_passage(spark, docs, rows, sf_dir):
    got = STAGES["repeated passages"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    source = {(d, t): s for d, t, s in rows}
    expected = []
    for (d, t, _), (_, n, gone, text) in zip(rows, brute_substring(rows), strict=True):
        if gone == 0 or gone < n:
            expected.append((d, text if gone else t, source[d, t]))
    assert kept(got) == sorted(map(str, expected))


def test_mix_stage_repeats_rows_as_drawn(spark, docs, sf_dir):
    got = STAGES["source mix"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    drawn = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        drawn[r["doc_id"]] += r["copies"]
    assert collections.Counter(r["doc_id"] for r in got.collect()) == +drawn


def test_packing_stage_loses_nothing(spark, docs, rows, sf_dir):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {(d, t): np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for d, t, _ in rows}
    expected = collections.Counter((d, i // 4096, zlib.crc32(ids[d, t][i : i + 4096].tobytes())) for d, t, _ in rows for i in range(0, len(ids[d, t]), 4096))
    got = STAGES["packing"](spark, docs, sf_dir).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == expected


@pytest.mark.parametrize("name", STAGES)
def test_a_stage_on_an_empty_table(spark, docs, sf_dir, name):
    got = STAGES[name](spark, docs.where("false"), sf_dir)
    assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)


@pytest.mark.parametrize("name", STAGES)
def test_a_stage_with_columns_of_clashing_names(spark, docs, rows, sf_dir, name):
    """The rows are those of the table without the extra columns."""
    clashing = frame(spark, rows).selectExpr("*", *[f"'x' as {c}" for c in ("__id", "__hash", "__copies", "__copy", "ends", "n_removed", "class_id")])
    got = STAGES[name](spark, clashing, sf_dir)
    plain = STAGES[name](spark, docs, sf_dir)
    if name == "packing":
        piece = lambda df: sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in df.collect())
        assert piece(got) == piece(plain)
    else:
        assert set(docs.columns) <= set(got.columns) and kept(got) == kept(plain)


def test_run_applies_the_stages_in_turn(spark, small):
    step = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, small)
    pieces = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert pieces(corpus_pipeline.run(spark, small)) == pieces(step)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_agrees_with_its_sql(spark, small, name):
    mine, other = compared(queries.queries()[name](spark, small), views(small), oracles.oracle_sql()[name])
    assert mine == other
