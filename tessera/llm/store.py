"""Tables and files written between the steps of one operator."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when its counted rows times their width stay under this.
BROADCAST_BYTES = 32 << 20
#: What `materialize` has written inside the innermost `scratch` of this thread.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`).

    Only a local session may lack the setting (tests); it then gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: the lineage ends
    there, and a lost executor costs no recomputation of what came before.  `codec`
    compresses it otherwise than the session says."""
    path = path or fresh_path(df.sparkSession, name)
    if (made := _scope.get()) is not None:
        made.append(path)
    return written(df, path, codec)


def written(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, items: str | None = None, item_bytes: int = 0) -> DataFrame:
    """Hint a broadcast when the counted rows of a written table are known to fit, with the
    counted elements of the array column `items`, if there is one."""
    counted = df.count() * row_bytes if items is None else df.agg(F.sum(row_bytes + F.size(items).cast("long") * item_bytes)).first()[0] or 0
    return F.broadcast(df) if counted <= BROADCAST_BYTES else df


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` written once as (row, doc): a unique number for every row, and all its columns.

    Decisions that are made about `row` hold for single rows, whatever doc_id they carry.
    """
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")), "numbered")


def fields(rows: DataFrame) -> DataFrame:
    """row, doc_id and text of a table made by `numbered`."""
    return rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))


def unnumbered(docs: DataFrame) -> DataFrame:
    """The same of plain documents; the numbers hold only within what is written at once."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of a `numbered` table whose row isn't in `dropped`, columns as they were.

    `dropped` is a written table: while its rows are few they are broadcast and no
    text is shuffled, otherwise both sides are shuffled by row.
    """
    return rows.join(broadcast_if_small(dropped.select("row"), 16), "row", "left_anti").select("doc.*")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Everything `materialize` writes inside is deleted at the end; write what is to last elsewhere."""
    made: list[str] = []
    before = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(before)
        for path in made:
            discard(spark, path)


def distilled(spark: SparkSession, build, name: str) -> DataFrame:
    """The table that `build` describes, written; what it wrote on its way is deleted."""
    path = fresh_path(spark, name)
    with scratch(spark):
        out = written(build(), path)
    if (made := _scope.get()) is not None:
        made.append(path)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
