"""A corpus in five steps: quality, near duplicates, repeated passages, source mix, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  ``run`` writes each
stage's rows to the shared folder and reads them again for the next.

A null text is an empty one in every stage.  An empty table gives no rows.  Extra columns are carried along; one that
has the name of a column which a stage works with (``score``; ``n_words``, ``n_removed``, ``kept_text``, ``begins``,
``ends``, ``text_hash``) comes out replaced or is left out, and columns whose names begin with two underscores, which
are the stages' own, are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import minhash, mixing, packing, quality, substring
from tallyfield.llm.common import materialize
from tallyfield.session import ship_package

ACCEPT = 0.7

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(function: Stage) -> Stage:
    """A stage that may be called by itself: its executors get the package first, columns named as its own go."""

    @wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, docs.drop(*[c for c in docs.columns if c.startswith("__")]), sf_dir)

    return staged


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them.

    Null and empty texts all have one score, the intercept's.  Rows that repeat are judged alike; rows without an id
    are judged but teach nothing.  Without any label every score is one half and nothing is kept.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(F.col("score") >= ACCEPT).drop("score")


@_stage
def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate class; rows without an id stay, rows that repeat an id are one document."""
    classes = minhash.near_duplicates(docs)
    others = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(materialize(others, "other-copies"), "doc_id", "left_anti").select(*docs.columns)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur earlier; those with nothing left go.

    Documents without words stay as they are.  Of rows that repeat an id one counts as earlier, by position, and rows
    without an id come in an order of their own: see :mod:`tallyfield.llm.substring`.
    """
    cut = substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    kept = cut.where("n_removed = 0 or n_removed < n_words")
    return kept.withColumns({"text": text, "n_chars": n_chars}).select(*[c for c in docs.columns if c in kept.columns])


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it.

    Rows without a source are a source of their own, the last; documents without words have size 0 and are not taken
    more than once.  Rows that agree in id, source and size share their copies.
    """
    return mixing.mixed_documents(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets; a document without text is one piece, its end.

    Rows that repeat are packed each; null ids stay null.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", one_of_each_class),
    ("repeated passages", without_repeats),
    ("source mix", mixed),
    ("packing", packed),
]

#: No stage but the first is a fixed expression over its input that SQL could repeat: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
