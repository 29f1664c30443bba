"""A table whose groups are replaced in one step, and published parts that are rewritten only when they changed.

A load first writes its rows into a folder of its own, then the list of which load holds which group, and last one
small file with the next number.  That file is the only thing readers look for, and it is created if nobody else has
created it, so a load that fails anywhere before leaves the old table as it was, and of two loads at once one fails.

    path/data/load=<id>/<group>=<value>/*.parquet     rows, never changed
    path/lists/<id>/*.parquet                         groups, their load and their digest
    path/versions/<number>                            the list that is valid from this version on
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.session import hadoop_path


@dataclass(frozen=True)
class Version:
    number: int
    list_id: str


def current(spark: SparkSession, path: str) -> Version | None:
    """The last version of a table, or null where there is none; a version without its content does not count."""
    folder, files = hadoop_path(spark, f"{path}/versions")
    if not files.exists(folder):
        return None
    numbers = sorted((int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit()), reverse=True)
    for n in numbers:
        held = spark.read.text(f"{path}/versions/{n:010d}").first()
        if held and held["value"]:
            return Version(n, held["value"])
    return None


def groups_of(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame | None:
    """The groups of a version with ``load`` and ``digest``; of the last one if none is given."""
    version = version or current(spark, path)
    return spark.read.parquet(f"{path}/lists/{version.list_id}") if version else None


def read(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame | None:
    """The rows of a version; null where nothing was written yet."""
    held = groups_of(spark, path, version)
    if held is None:
        return None
    keys = [c for c in held.columns if c != "digest"]
    return spark.read.parquet(f"{path}/data").join(F.broadcast(held.select(*keys)) if held.count() <= MOST_BROADCAST else held.select(*keys), keys, "left_semi").drop("load")


#: Groups up to which the list of a version is broadcast (some tens of bytes each).
MOST_BROADCAST = 100_000


def _commit(spark: SparkSession, path: str, before: Version | None, held: DataFrame, load: str) -> Version:
    held.write.parquet(f"{path}/lists/{load}")
    version = Version(before.number + 1 if before else 1, load)
    file, files = hadoop_path(spark, f"{path}/versions/{version.number:010d}")
    out = files.create(file, False)  # fails if another load was faster
    out.write(bytearray(load.encode()))
    out.close()
    return version


def replace_groups(rows: DataFrame, path: str, group: list[str], gone: DataFrame | None = None, digest: Column | None = None) -> Version:
    """Replace the groups that ``rows`` hold, drop those of ``gone``, and leave the rest: all of it or nothing.

    An empty load replaces nothing.  Rows keep their order in no way; a group's columns come last on reading.
    """
    spark, load = rows.sparkSession, uuid.uuid4().hex
    before = current(spark, path)
    rows.withColumn("load", F.lit(load)).write.partitionBy("load", *group).mode("append").parquet(f"{path}/data")
    kept = (digest if digest is not None else F.lit(None)).cast("string").alias("digest")
    new = rows.select(*group, F.lit(load).alias("load"), kept).distinct()
    old = groups_of(spark, path, before) if before else None
    if old is not None:
        for other in (new, gone):
            old = old if other is None else old.join(other.select(*group), group, "left_anti")
        new = old.unionByName(new)
    return _commit(spark, path, before, new, load)


def republish(documents: DataFrame, path: str, part: list[str], document: str = "document") -> tuple[Version | None, bool]:
    """Publish documents, one for each part: those that changed are written, those that are gone are dropped.

    The version stays, and nothing is written, if no part differs from the last version.  Returns the version and
    whether it is new.
    """
    spark = documents.sparkSession
    digested = documents.withColumn("digest", F.sha2(document, 256))
    before = current(spark, path)
    if before is None:
        return replace_groups(digested, path, part, digest=F.col("digest")), True
    held = groups_of(spark, path, before)
    changed = digested.join(held.select(*part, F.col("digest").alias("was")), part, "left").where("was is null or was <> digest").drop("was")
    gone = held.join(documents.select(*part), part, "left_anti")
    if changed.isEmpty() and gone.isEmpty():
        return before, False
    return replace_groups(changed, path, part, gone, F.col("digest")), True


def remove_unlisted(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove what loads that failed left behind and what only versions before the last ``keep`` hold; how many folders went.

    Not to be run while a load is being written.
    """
    last = current(spark, path)
    if last is None:
        return 0
    folder, files = hadoop_path(spark, f"{path}/versions")
    kept = sorted((s.getPath().getName() for s in files.listStatus(folder)), reverse=True)[:keep]
    lists = [r["value"] for n in kept for r in spark.read.text(f"{path}/versions/{n}").collect()]  # ``keep`` rows
    loads = {r["load"] for i in lists for r in spark.read.parquet(f"{path}/lists/{i}").select("load").distinct().collect()}
    removed = 0
    for sub, wanted in (("data", {f"load={x}" for x in loads}), ("lists", set(lists)), ("versions", set(kept))):
        folder, files = hadoop_path(spark, f"{path}/{sub}")
        for status in files.listStatus(folder):
            if status.getPath().getName() not in wanted and not status.getPath().getName().startswith("_"):
                files.delete(status.getPath(), True)
                removed += 1
    return removed
