"""Places in a global order, and CRC-32 in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def number_rows(df: DataFrame, by: list, name: str, column: str = "at") -> DataFrame:
    """df with its rows' places (long, from 0) in the order of by, in a settled table.

    Rows are dealt by ranges and sorted where they fall; only the counts of the sorted partitions are added up, so no
    task sees more than a range. The last of by should tell equal rows apart (a place in a settled table does), so that
    a range can be cut anywhere. df is read twice (Spark samples it for the ranges): hand in a settled table.
    """
    spark = df.sparkSession
    kept = settle(df.orderBy(*by).withColumn("_mono", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mono", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    held, rows = 0, []
    for r in counts.orderBy("_part").collect():  # a row a partition of the sort
        rows.append((r._part, held))
        held += r._n
    starts = F.broadcast(spark.createDataFrame(rows, "_part long, _start long"))
    out = kept.withColumn("_part", part).join(starts, "_part").withColumn(column, F.col("_start") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
    out = out.drop("_part", "_start", "_mono")
    out.settled_path = kept.settled_path
    return out


def per_group(df: DataFrame, group: str, at: str = "at") -> DataFrame:
    """group, first, n: where each group of a numbered table begins and how many rows it has."""
    return df.groupBy(group).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))


#: A one-row table with the list t of the 256 remainders of CRC-32, by the polynomial's rule.
CRC_TABLE_SQL = "(SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(1, 9)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(k)))"


def crc_sql(value: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes; CRC_TABLE_SQL must be among the tables of the query. Nothing else in it may be called h or t."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen({value}) + 1), lambda i: CAST('0x' || substr(hex({value}), CAST(2 * i - 1 AS INT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
