"""Helpers shared by the corpus operators: shared storage, Arrow batches, worker caches."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of this machine, which only local mode may use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str, codec: str = "uncompressed") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, and a lost executor costs a re-read.

    Hashes and ids don't compress, and codecs hold native memory; texts want "zstd".
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def _store(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def discard(*frames: DataFrame) -> None:
    """Delete settled tables that no later step reads. settled_path may end in a star."""
    for df in frames:
        if path := getattr(df, "settled_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, pattern: str) -> None:
    """Delete what a path, or a path that ends in a star, stands for."""
    store, where = _store(spark, pattern)
    for found in store.globStatus(where) or []:
        store.delete(found.getPath(), True)


def discard_all(spark: SparkSession, prefix: str) -> None:
    """Delete the settled tables whose names begin so; what is still to be read must have been settled under another name."""
    remove(spark, f"{shared_dir(spark)}/{prefix}*")


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that are gone when the driver collects its garbage; between the steps of a long job that keeps disks free."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an uncompressed settled table that every task may hold in a hash join.
MAX_BROADCAST = 8 << 20


def broadcastable(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """A settled table, to be broadcast if its files are that small; larger ones are joined by a shuffle, whose hot keys Spark splits."""
    store, where = _store(df.sparkSession, df.settled_path)
    return F.broadcast(df) if store.getContentSummary(where).getLength() <= most else df


def few_tasks(df: DataFrame, rows: int, row_bytes: int = 320, task_bytes: int = 16 << 20) -> DataFrame:
    """df in no more tasks than so many rows of that size are worth, where its partitions are many and small; large tables stay as they are."""
    tasks = max(6, rows * row_bytes // task_bytes + 1)
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Tells rows of one id apart by their texts; joins compare the id as well."""
    return F.xxhash64(id_col, text_col)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, so tasks that reuse the worker find what earlier ones built."""
    return sys.modules["sys"].__dict__.setdefault("_tidemark_worker_cache", {})


def tidy() -> None:
    """Give freed memory back to the system, between large pieces of work in a Python worker."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A function over Arrow batches that gives its memory back to the system when its task ends, before the worker goes on to another."""

    def whole(batches):
        yield from run(batches)
        tidy()

    return whole


def slices(batches, rows: int = 256):
    """Arrow batches in small slices: Python copies of texts stay few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches, *columns: int, most: int = 1 << 20, rows: int = 4096):
    """Arrow batches in slices whose texts, of these columns, hold so many bytes at most, or of one row: arrays over all words of a slice stay small."""
    for batch in batches:
        ends = np.cumsum(sum(np.asarray(pc.binary_length(batch.column(c)).fill_null(0)).astype(np.int64) for c in columns))
        at = 0
        while at < batch.num_rows:
            until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            until = min(max(at + 1, until), at + rows)
            yield batch.slice(at, until - at)
            at = until


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """Lower-cases A-Z only; lower() would also change other alphabets."""
    return F.translate(col, UPPER, LOWER)
