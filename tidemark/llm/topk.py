"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows; a dimension is a term. Candidates are cut into blocks (by a hash of the row and its
place in the input, so their number follows the table and repeated rows spread), queries likewise, and every pair of blocks meets in one row of a join
on the pair's number: a block of queries is sent once to each candidate block, so what is sent grows with the queries
times the candidate blocks, and the blocks' size is what to raise for many queries. Within a pair the
candidate block is inverted into one posting list a term (rows and weights); for each term the weights
of the queries that hold it are scattered, times the postings, into dense score arrays. A partition
selection keeps each query's k best of the block, ties to the smaller id, and the blocks' lists are
merged by one grouped top-k.

Every score is exact in 64-bit integers; finite components of 2^55 / scale (2^49 here) or more, or vectors whose
scores could leave that range, raise an error.

Edge cases: null vectors, null or non-finite components: left out, as queries and as candidates; vectors
of unequal lengths: a missing component counts as 0; empty vectors score 0; repeated ids: a query leaves
out all rows of its own id, rows of that id share one list, and repeated candidates rank one by one; fewer than k candidates: all of
them; an empty table: an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BLOCK = "block int, ids binary, lens binary, weights binary"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def unpack(ids: bytes, lens: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids and a dense int64 matrix, rows in the order of ids."""
    ids, lens, flat = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int32), np.frombuffer(weights, np.int64)
    out = np.zeros((len(ids), int(lens.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lens[:, None]] = flat
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all queries against all rows of a block, term by term."""
    terms = min(queries.shape[1], rows.shape[1])
    most = max([0, *(int(np.abs(queries[:, t]).max(initial=0)) * int(np.abs(rows[:, t]).max(initial=0)) for t in range(terms))]) * max(terms, 1)
    if most >= 2**62:
        raise ValueError("scores may leave the range of 64-bit integers")
    kind = np.int32 if most < 2**31 else np.int64
    scores = np.zeros((len(queries), len(rows)), kind)
    columns = np.ascontiguousarray(rows.T.astype(kind))
    for t in range(terms):
        holds = np.flatnonzero(queries[:, t])
        posting = np.flatnonzero(columns[t])
        if not len(holds) or not len(posting):
            continue
        dense = 2 * len(posting) > len(rows)
        weights = columns[t] if dense else columns[t][posting]
        for q in holds:
            w = kind(queries[q, t])
            if dense:
                scores[q] += w * weights
            else:
                scores[q, posting] += w * weights
    return scores


def best_of_block(query_ids, queries, ids, rows, k: int, step: int = 128):
    """(query_id, vec_id, score) of each query's k best rows; rows are in order of id."""
    for at in range(0, len(queries), step):
        scores = accumulate(queries[at : at + step], rows).astype(np.int64)
        for q, row in zip(query_ids[at : at + step], scores):
            own = slice(np.searchsorted(ids, q), np.searchsorted(ids, q, side="right"))
            keep = np.ones(len(ids), bool)
            keep[own] = False
            if keep.sum() > k:
                floor = np.partition(row[keep], len(row[keep]) - k)[-k]
                above = np.flatnonzero(keep & (row > floor))
                tied = np.flatnonzero(keep & (row == floor))[: k - len(above)]
                take = np.concatenate([above, tied])
            else:
                take = np.flatnonzero(keep)
            yield np.full(len(take), q, np.int64), ids[take], row[take]


def blocks(vectors: DataFrame, rows_per_block: int, rows: int) -> DataFrame:
    """One row a block: ids, lengths and weights, packed."""
    n = max(1, math.ceil(rows / rows_per_block))

    def pack(key, pdf):
        import pandas as pd

        lens = pdf["w"].map(len).to_numpy(np.int32)
        flat = np.concatenate(list(pdf["w"])) if len(pdf) else np.zeros(0)
        return pd.DataFrame({"block": [key[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "lens": [lens.tobytes()], "weights": [flat.astype(np.int64).tobytes()]})

    return vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "w", F.monotonically_increasing_id()), F.lit(n)).cast("int")).groupBy("block").applyInPandas(pack, BLOCK), n


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64, rows_per_block: int = 8192, queries_per_block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by query_every, against all rows."""
    id_col, vector_col = f"`{id_col}`", f"`{vector_col}`"
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**55 / scale))
    huge = F.exists(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) >= 2.0**55 / scale) & (F.abs(x.cast("double")) < float("inf")))
    checked = F.when(huge, F.raise_error(F.lit("a component leaves the range of exact scores")).cast("array<bigint>")).when(sound, whole)
    base = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), checked.alias("w")).where(F.col("w").isNotNull())
    asked = F.col("vec_id") % query_every == 0
    rows, n_queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col(id_col) % query_every == 0, 1))).first()
    candidates, n = blocks(base, rows_per_block, rows)
    queries, _ = blocks(base.where(asked), queries_per_block, n_queries)
    sent = queries.select(F.struct("ids", "lens", "weights").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    pairs = sent.join(candidates, "block").select(F.col("q.ids").alias("qi"), F.col("q.lens").alias("ql"), F.col("q.weights").alias("qw"), "ids", "lens", "weights")

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                qi, ql, qw, ids, lens, weights = (c[r].as_py() for c in batch.columns)
                parts = list(best_of_block(*unpack(qi, ql, qw), *unpack(ids, lens, weights), k))
                for at in range(0, len(parts), 512):
                    q, v, s = (np.concatenate(x) for x in zip(*parts[at : at + 512]))
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], schema=FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
