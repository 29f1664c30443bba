"""Reading what scrapers and interfaces have landed: pages, JSON, scripts and snapshot indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.schema import SCRAPED_GROUP


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """path and html of landed page files."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("html"))


def scraped_groups(spark: SparkSession, path: str) -> DataFrame:
    """Raw scrapes of groups with their tables and rounds, by schema (no inference pass)."""
    return spark.read.schema(SCRAPED_GROUP).json(path, multiLine=True)


def scraped_standings(groups: DataFrame) -> DataFrame:
    return groups.select("competition_id", "group_id", "group_name", F.explode("standings").alias("s")).select("competition_id", "group_id", "group_name", "s.*")


def scraped_matches(groups: DataFrame) -> DataFrame:
    """One row per match; groups with empty lists give none."""
    rounds = groups.select("competition_id", "group_id", F.posexplode("jornadas").alias("round_seq", "r"))
    return rounds.select("competition_id", "group_id", "round_seq", F.col("r.num").alias("round"), F.col("r.date").alias("round_date"), F.explode("r.matches").alias("m")).select("competition_id", "group_id", "round_seq", "round", "round_date", "m.*")


def script_value(text: Column, name: str, schema: str) -> Column:
    """The JSON value that a script gives a constant: ``const NAME = …;`` up to the first semicolon outside a string.

    Signs after a backslash do not end a string; without a semicolon the value runs to the end.
    """
    body = F.regexp_extract(text, rf"(?s)\b(?:const|let|var)\s+{name}\s*=\s*(.*)", 1)
    parts = F.split(F.regexp_replace(body, r"(?s)\\.", "xx"), '"')
    shown = F.concat_ws('"', F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit("x"), F.length(p))).otherwise(p)))
    end = F.instr(shown, ";")
    return F.from_json(F.when(end > 0, F.substring(body, F.lit(1), end - 1)).otherwise(body), schema)


def script_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def newest_snapshots(index: DataFrame, first: str, last: str) -> DataFrame:
    """Of an archive index (slug, timestamp, digest, status): each slug's newest good snapshot in a range.

    Snapshots with equal digests are one, the earliest.
    """
    good = index.where((F.col("status") == 200) & F.col("timestamp").between(first, last))
    once = good.groupBy("slug", "digest").agg(F.min("timestamp").alias("timestamp"))
    return once.groupBy("slug").agg(F.max(F.struct("timestamp", "digest")).alias("x")).select("slug", "x.*")


def season_partition(spark: SparkSession, path: str, season: int) -> DataFrame:
    """One season of a partitioned table; the filter prunes the other folders."""
    return spark.read.parquet(path).where(F.col("season") == season)
