"""Tables written to the shared folder and read again: lineage ends there, and a lost executor costs a read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..streaming.bars import place_for


def store(df: DataFrame, name: str) -> DataFrame:
    spark, path = df.sparkSession, place_for(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
