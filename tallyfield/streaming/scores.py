"""The incremental refresh as a stream: late scores fill in what is stored, event by event or batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfield.operators.merge import fill_nulls, one_of_each, replace_groups
from tallyfield.session import release, written

KEY, SCORES = ["season", "grp", "round", "home", "away"], ["home_score", "away_score"]


def score_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Fixture files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def once_per_event(events: DataFrame, key: list[str], time: str, delay: str = "2 days") -> DataFrame:
    """Events without repeats; state older than the watermark is dropped."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def goals_by_window(events: DataFrame, time: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Goals per group and window of event time."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy("grp", F.window(time, width).alias("w")).agg(F.sum(F.col("home_score") + F.col("away_score")).alias("goals"), F.count("*").alias("results"))


def merge_scores(stream: DataFrame, path: str, checkpoint: str, replace: bool = False) -> StreamingQuery:
    """Merge each micro-batch into the table at ``path``: fill missing scores, or replace groups that grew.

    Of several rows of a key in one batch one with a score counts, whatever their order.  Only the groups a batch
    touches are read and written again: written beside first, then over, as a table is never read and overwritten in
    one job.  Merging the same batch twice changes nothing, so a restarted query is safe.  What a batch writes
    beside the table is removed with it.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = written(one_of_each(batch, KEY, SCORES), "batch")
        steps, groups = [rows], rows.select("season", "grp").distinct()
        try:
            stored = spark.read.schema(rows.schema).parquet(path).join(groups, ["season", "grp"], "left_semi").select(*rows.columns)
            stored = written(stored, "stored")
            steps.append(stored)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = rows.limit(0)
        merged = written(replace_groups(stored, rows, ["season", "grp"]) if replace else fill_nulls(stored, rows, KEY, SCORES), "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "grp").parquet(path)
        release(*steps, merged)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
