"""Session helpers: where shared scratch data goes, and how lineage is cut."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What one task holds of rows of numbers, by 8 bytes a number and 24 numbers more a row for objects and keys.
TASK_BYTES = 64 << 20
ROW_NUMBERS = 24


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tabweave-")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local temporary one only for local masters."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder, so a lost executor costs a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(rows: int, width: int) -> int:
    """Number of tasks for so many rows of ``width`` numbers: a task's share doesn't grow with the input."""
    return max(1, -(-rows * (width + ROW_NUMBERS) * 8 // TASK_BYTES))


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that :func:`scratch_path` named and that no frame in use reads."""
    if not path.startswith(shared_folder(spark) + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
