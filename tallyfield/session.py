"""Session defaults, and shipping this package to executors that do not have it installed."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "tallyfield", **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword arguments are further settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tallyfield_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tallyfield-")) / "tallyfield.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    context.addPyFile(str(target))
    context._tallyfield_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder takes its place, but only on a local master: executors of a cluster
    do not see the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyfield-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*steps: DataFrame) -> None:
    """Remove the files of steps that were written and that nothing to come reads."""
    for step in steps:
        folder, files = hadoop_path(step.sparkSession, step._written_at)
        files.delete(folder, True)


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system it lies in, as Spark's own readers see them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())
