"""Intermediate tables in the folder that driver and executors share: lineage is cut, and lost executors lose nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests, one machine) a folder made once. A cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext.getCheckpointDir()
        if not made:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siftkite-"))
            made = spark.sparkContext.getCheckpointDir()
        base = made
    return base.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/siftkite-{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            delete_path(spark, path)
        except Exception:  # the session may have ended before; the folder's owner clears it then
            pass

    atexit.register(clean)
    return path


def stage(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. Lost executors don't lose it.

    `replaces`: a staged table that nothing needs once this one is written; its files are deleted then.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    drop_staged(replaces)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(table: DataFrame | None) -> None:
    """Delete the files of a staged table that nothing needs any more."""
    if table is not None and (path := getattr(table, "_staged_at", None)):
        delete_path(table.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt evenly, whatever they hold, to four tasks for each core or more: a file of one row group is read by one task, and what follows would be too."""
    spark, nth = df.sparkSession, "_spread"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.withColumn(nth, F.monotonically_increasing_id()).repartition(tasks, nth).drop(nth)


#: Rows of a staged table that one task sorts or groups.
TASK_ROWS = 250_000


def tasks_for(table: DataFrame, rows: int | None = None) -> int:
    """Tasks among which rows of a staged table are to be dealt, so that one has about `rows` (TASK_ROWS), however large the table is; spark.sql.shuffle.partitions at least."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // (rows or TASK_ROWS)))
