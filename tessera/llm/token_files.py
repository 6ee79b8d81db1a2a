"""Token-id output: a wavelet matrix per shard, written and read by Spark tasks."""

from __future__ import annotations

import posixpath
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import fresh_path, materialize, partitions
from .tokens import default_path, encoder
from .wavelet import WaveletShard, encode

SHARD_TOKENS = 1 << 21


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all; a task that runs again writes the same."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    store.create_dir(path, recursive=True)
    part = posixpath.join(path, f"_{name}.{uuid.uuid4().hex}")
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, posixpath.join(path, name))


def _write(folder: str, path: str, shard_tokens: int):
    def task(batches):
        tokenizer, part = encoder(path), TaskContext.get().partitionId()
        docs: list = []
        ids: list[np.ndarray] = []
        waiting = written = 0

        def flush():
            nonlocal waiting, written, docs, ids
            sizes, name = [len(x) for x in ids], f"{part:06d}-{written:06d}.wmx"
            nulls = [i for i, d in enumerate(docs) if d is None]
            _put(folder, name, encode(np.concatenate(ids), np.array([d or 0 for d in docs], np.int64), np.array(sizes), nulls))
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (part, pa.int64()), (written, pa.int64()), (len(docs), pa.int64()), (waiting, pa.int64()))], ["name", "part", "number", "n_docs", "n_tokens"])
            docs, ids, waiting, written = [], [], 0, written + 1
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc_id)
                ids.append(tokenizer.with_end(text))
                waiting += len(ids[-1])
                if waiting >= shard_tokens:
                    yield flush()
        if docs:
            yield flush()

    return task


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode `docs` (doc_id, text) into wavelet files in `folder`, in ascending doc_id order.

    Returns the list of files: name, part, number, n_docs, n_tokens, base (the
    ids of all files before).  Null and empty texts are their end id 0 alone; a
    null doc_id comes first; repeated rows are separate documents.  A task holds
    one shard of `shard_tokens` ids, or one longer document.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = own.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    files = materialize(ordered.mapInArrow(_write(folder, path or default_path(), shard_tokens), "name string, part long, number long, n_docs long, n_tokens long"), "files")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))  # as many rows as tasks
    parts = parts.withColumn("before", F.sum("size").over(upto(Window.orderBy("part"))) - F.col("size"))
    within = F.sum("n_tokens").over(upto(Window.partitionBy("part").orderBy("number"))) - F.col("n_tokens")
    return files.withColumn("within", within).join(parts, "part").select("name", "part", "number", "n_docs", "n_tokens", (F.col("before") + F.col("within")).alias("base"))


def _read(batches):
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = WaveletShard(data)
            ids, ends = shard.decode().astype("<u4"), np.cumsum(shard.sizes.astype(np.int64))
            starts = ends - shard.sizes
            nulls = set(shard.header["nulls"])
            doc_ids = [None if i in nulls else d for i, d in enumerate(shard.doc_ids.tolist())]
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array([name] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(shard.sizes.astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document in the wavelet files: name, doc_id, at (its first id in the file), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wmx").load(folder)
    # one file a batch at a time is decoded; files are read where the scan puts them
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(_read, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the token files of `docs` in the shared folder and read them back.

    One row per document: doc_id, start, n_tokens, ids_crc32.  An empty table gives none.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    files = write_tokens(docs, folder, path)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder).join(files.select("name", "base"), "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
