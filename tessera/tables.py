"""Tables written between the steps of one operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS = 1 << 18  # rows that a task gets from a large table


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`.  Only a local session may lack the setting; it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet and read back: its lineage ends there, and rows stay as they are."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, made from `rows` rows, dealt by the hash of `keys` to tasks of about ROWS rows each.

    What is then grouped or joined by these keys (or grouped by more) is shuffled no more, and
    a task's hash tables stay as small as they are, whatever the size of the table.  Left to
    itself, Spark has a fixed number of shuffle partitions, merged by their compressed bytes.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)


def discard(df: DataFrame) -> None:
    """Delete the table that `written` gave; nothing may read it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
