"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters whole records uniformly over memory-sized buckets by a seeded hash of id, text and place in the input (so
that repeated rows spread) and writes them to the shared folder. Pass 2 gathers each bucket, a partition holding many of
them one after the other in order of their numbers (a task's random stream is one), orders each by the same hash (so that
the outcome doesn't hang on arrival order) and applies Spark's seeded ``shuffle``, which is a Fisher-Yates shuffle. Buckets laid end to end give one random order of all records; shard s
takes the records from floor(s*N/S) to floor((s+1)*N/S), so that counts differ by one at most and a bucket is written to
few shards, with no further shuffle. A place is a partition and a row, so one layout of the input gives one outcome.

Edge cases: a null text has no bytes and is kept; null and repeated ids are kept; an empty table gives an empty result;
extra columns ride along, also if they are named like the operator's own (those of the operator stand beside the record).
Records must be orderable (no map columns).
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcastable, discard, settle, shared_dir, table

#: Buckets whose sizes one task adds up; as many runs of them as there are meet in one more.
STEP = 4096


def record_size(text: str = "text"):
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16


def shard_records(docs: DataFrame, n_shards: int = 40, seed: int = 20240229, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: rec (the whole record as a struct), shard int, slot long (gapless from 0 in each shard).

    bucket_bytes is the share of a task's memory that a bucket may take; the number of buckets follows the input. The
    result reads the scattered records; discard() of it deletes them when it has been used.
    """
    spark, run = docs.sparkSession, f"shards_{uuid.uuid4().hex}"
    total, rows = docs.agg(F.sum(record_size(f"`{text_col}`")), F.count(F.lit(1))).first()
    rows, n_buckets = rows or 0, max(1, math.ceil((total or 0) / bucket_bytes))
    parts = min(n_buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.monotonically_increasing_id())
    keyed = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"))
    scattered = settle(keyed.select(F.pmod("key", F.lit(n_buckets)).cast("int").alias("bucket"), F.xxhash64(F.lit(seed + 1), "key").alias("k"), "rec"), f"{run}-scattered", "snappy")
    counts = settle(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), f"{run}-buckets")
    # the running total of bucket sizes: of runs of STEP buckets, and inside each run
    step = F.expr(f"bucket div {STEP}")
    before = counts.groupBy(step.alias("run")).agg(F.sum("n").alias("n")).select("run", (F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    inside = F.sum("n").over(Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = settle(counts.withColumn("run", step).withColumn("inside", inside).join(before, "run").select("bucket", (F.col("first") + F.col("inside")).alias("base")), f"{run}-offsets")
    mixed = (
        scattered.withColumn("part", F.expr(f"CAST(bucket * {parts}L div {n_buckets}L AS INT)"))
        .repartitionById(parts, F.col("part"))
        .groupBy("part", "bucket")
        .agg(F.collect_list(F.struct("k", "rec")).alias("items"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle(F.array_sort("items"), F.lit(seed)).alias("items"))
        .join(broadcastable(offsets), "bucket")
        .select("base", F.posexplode("items").alias("pos", "item"))
        .select((F.col("base") + F.col("pos")).alias("at"), F.col("item.rec").alias("rec"))
    )
    shard = F.expr(f"((at + 1) * {n_shards}L - 1) div {max(rows, 1)}L")
    out = mixed.select("rec", "at", shard.alias("s")).select("rec", F.col("s").cast("int").alias("shard"), (F.col("at") - F.expr(f"(s * {rows}L) div {n_shards}L")).alias("slot"))
    out.settled_path = f"{shared_dir(spark)}/{run}-*"
    return out


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; slot gives the order inside. Bucket order is shard order, so a task writes to few shards."""
    sharded.write.partitionBy("shard").parquet(path)


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_records(table(spark, sf_dir, "documents"))
    out = sharded.select(
        F.col("rec.doc_id").alias("doc_id"),
        record_size("rec.text").alias("size"),
        F.crc32(F.col("rec.text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
    out = settle(out, "sharded", "snappy")
    discard(sharded)
    return out
