"""Importance resampling towards a target corpus, by bucket-partitioned inverted postings.

Features of a text are its runs of 1 to ``max_run`` words; a feature's bucket is the CRC-32 of its bytes modulo the number
of buckets. How much likelier a bucket is in the target than in the documents is its gain; a document weighs the mean gain
of its features. Gumbel noise, seeded by doc_id, is added to the weight, and the highest scores are a draw without
replacement in proportion to exp(weight).

1. A pass over the texts writes postings (bucket, document, count), inverted by blocks of documents: a row holds what one
   block (512 documents at most) has in one group of neighbouring buckets, and the group's totals for that block. A
   document of any length is read in pieces, so a task holds one block.
2. Totals of buckets are summed on the map side and meet the target's totals, bucket by bucket: one row a group.
3. Postings are dealt by group of buckets, groups by salts, so that a bucket that every document has is spread as well; the
   group's totals of both corpora stand first in each share. A task works out the gains of its buckets from them and turns
   postings into contributions: one sum a document of the block.
4. Contributions meet their block's list of documents and are added up. Ranks come from a sort by ranges.

Neither gains nor postings are broadcast or gathered; every row of a shuffle is bounded by a block and a group.

Edge cases: null and empty texts, and texts without words, have no features, weight 0 and are never drawn; equal scores
are ordered by doc_id, a null doc_id last (its noise is that of an empty id); repeated rows each count and each get a row;
an empty target leaves gains to the smoothing alone; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, settle, slices, table, tidied, worker_cache
from .ordering import CRC_TABLE_SQL, crc_sql, number_rows

#: Documents of a block, at most; words after which a block is closed.
BLOCK, BLOCK_WORDS = 512, 200_000
#: Groups of neighbouring buckets.
GROUPS = 16
#: A-Z to a-z, what is neither a letter, a digit nor beyond ASCII to a blank.
NORMAL = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
POSTINGS = "block long, g int, ids array<long>, words binary, keys binary, counts binary, sums array<long>"
PIECE = 1 << 20


class Shift:
    """Appending zero bytes to data whose CRC-32 is known: a linear map, so four looked-up remainders a value."""

    DIRECT = 64

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
        at = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        tables = [at]
        for _ in range(self.DIRECT):
            tables.append((tables[-1] >> np.uint32(8)) ^ step[tables[-1] & np.uint32(255)])
        self.flat, self.doubling = np.concatenate([t.ravel() for t in tables]), [tables[1]]

    @staticmethod
    def through(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]

    def __call__(self, c: np.ndarray, by: np.ndarray) -> np.ndarray:
        at = np.minimum(by, self.DIRECT) * 1024
        out = self.flat[at + (c & 255)] ^ self.flat[at + 256 + ((c >> 8) & 255)] ^ self.flat[at + 512 + ((c >> 16) & 255)] ^ self.flat[at + 768 + (c >> 24)]
        far = np.flatnonzero(by > self.DIRECT)
        if len(far):
            left, value, k = by[far] - self.DIRECT, out[far], 0
            while left.any():
                while len(self.doubling) <= k:
                    self.doubling.append(self.through(self.doubling[-1], self.doubling[-1]))
                odd = (left & 1).astype(bool)
                value[odd] = self.through(self.doubling[k], value[odd])
                left, k = left >> 1, k + 1
            out[far] = value
        return out


class Words(dict):
    """Words to numbers; of each word the CRC-32, that of a blank and the word, and the length of the latter."""

    LIMIT = 250_000

    def __init__(self):
        self.crc, self.tail, self.size = array("L"), array("L"), array("L")

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.crc.append(zlib.crc32(word))
        self.tail.append(zlib.crc32(b" " + word))
        self.size.append(len(word) + 1)
        return i

    def of(self, column: str, ids: np.ndarray) -> np.ndarray:
        return np.frombuffer(getattr(self, column), np.uint64)[ids].astype(np.int64)


def pieces(text: bytes):
    """A normalised text in pieces that end between words."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def run_buckets(words: Words, shift: Shift, ids: np.ndarray, docs: np.ndarray, known: int, max_run: int, n_buckets: int):
    """(bucket, document) arrays of all runs that end at place known or later."""
    crc = words.of("crc", ids)
    yield crc[known:] % n_buckets, docs[known:]
    tail, size = words.of("tail", ids), words.of("size", ids)
    for k in range(2, max_run + 1):
        if len(ids) < k:
            return
        crc = shift(crc[: len(ids) - k + 1], size[k - 1 :]) ^ tail[k - 1 :]
        first = max(0, known - k + 1)
        whole = docs[: len(ids) - k + 1][first:] == docs[k - 1 :][first:]
        yield crc[first:][whole] % n_buckets, docs[k - 1 :][first:][whole]


def added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Integers as four planes of bytes, of which codecs shrink the upper ones to nothing."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def postings(docs: DataFrame, max_run: int, n_buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of a block and a group of buckets: keys ((bucket - first of the group) * BLOCK + document, as steps), counts less one, sums of the buckets. A row of group -1 lists the block's documents and their numbers of words."""
    width = math.ceil(n_buckets / GROUPS)

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        cache = worker_cache()
        shift = cache.setdefault("crc shift", Shift())
        words, ids, sizes, keys, counts, seen, docs_of, pending = Words(), [], [], [], [], [], [], 0

        def count(last: int):
            """Pending words become counted keys; the last words of the document stay as the start of further runs."""
            nonlocal pending
            known = seen[0][1] if seen else 0
            all_ids, all_docs = np.concatenate([x for x, _ in seen]), np.concatenate(docs_of)
            found = [b * BLOCK + d for b, d in run_buckets(words, shift, all_ids, all_docs, known, max_run, n_buckets)]
            k, n = np.unique(np.concatenate(found), return_counts=True)
            keys.append(k)
            counts.append(n)
            if len(keys) > 64:
                keys[:], counts[:] = ([x] for x in added_up(keys, counts))
            keep = min(max_run - 1, int((all_docs[-max_run:] == last).sum()), len(all_ids)) if max_run > 1 and len(all_ids) else 0
            seen[:], docs_of[:] = [(all_ids[len(all_ids) - keep :], keep)], [all_docs[len(all_ids) - keep :]]
            pending = 0

        def block():
            count(-1)
            k, n = added_up(keys, counts)
            name, out = part << 32 | made, {f: [] for f in ("block", "g", "ids", "words", "keys", "counts", "sums")}

            def row(*values):
                for column, v in zip(out.values(), values):
                    column.append(v)

            row(name, -1, ids, np.array(sizes, "<i8").tobytes(), None, None, None)
            ends = np.searchsorted(k, np.arange(GROUPS + 1) * width * BLOCK)
            for g in range(GROUPS):
                own, many = k[ends[g] : ends[g + 1]] - g * width * BLOCK, n[ends[g] : ends[g + 1]]
                if len(own):
                    row(name, g, None, None, packed(np.diff(own, prepend=0)), packed(many - 1), np.bincount(own // BLOCK, many, width).astype(np.int64).tolist())
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds)], list(out))

        for batch in slices(batches, 64):
            for i in range(batch.num_rows):
                text, n = (batch.column(1)[i].as_py() or b"").translate(NORMAL), 0
                for piece in pieces(text):
                    split = piece.split()
                    seen.append((np.fromiter(map(words.__getitem__, split), np.int64, len(split)), 0))
                    docs_of.append(np.full(len(split), len(ids), np.int64))
                    n, pending = n + len(split), pending + len(split)
                    if pending >= BLOCK_WORDS and len(text) > PIECE:
                        count(len(ids))
                ids.append(batch.column(0)[i].as_py())
                sizes.append(n)
                if len(ids) == BLOCK or pending >= BLOCK_WORDS or len(text) > PIECE:
                    if not seen:
                        seen, docs_of = [(np.zeros(0, np.int64), 0)], [np.zeros(0, np.int64)]
                    yield block()
                    made += 1
                    ids, sizes, keys, counts, seen, docs_of, pending = [], [], [], [], [], [], 0
                    if len(words) > Words.LIMIT:
                        words = Words()
        if ids:
            if not seen:
                seen, docs_of = [(np.zeros(0, np.int64), 0)], [np.zeros(0, np.int64)]
            yield block()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).mapInArrow(tidied(run), POSTINGS)


def bucket_totals(docs: DataFrame, target: DataFrame) -> DataFrame:
    """g, s, t: for each group of buckets the lists of its buckets' totals in both corpora."""
    both = docs.select("g", "sums", F.lit(1).alias("own")).unionByName(target.select("g", "sums", F.lit(0).alias("own"))).where("g >= 0")
    one = both.select("g", "own", F.posexplode("sums").alias("b", "n")).groupBy("g", "b").agg(F.sum(F.expr("n * own")).alias("s"), F.sum(F.expr("n * (1 - own)")).alias("t"))
    rows = one.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("b", "s", "t"))).alias("x"))
    return rows.select("g", F.col("x.s").alias("s"), F.col("x.t").alias("t"))


def gains(s, t, n_docs: int, n_target: int, n_buckets: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (n_docs + float(n_buckets)) / ((float(a) + 1) * (n_target + float(n_buckets))))) for a, b in zip(s, t)], np.int64)


def weights(docs: DataFrame, target: DataFrame, max_run: int = 2, n_buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight (all long): thousandths of the mean log ratio of a document's features. discard() of it deletes its postings."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = settle(postings(docs, max_run, n_buckets, id_col, text_col), "postings", "snappy")
    totals = settle(bucket_totals(blocks, postings(target, max_run, n_buckets, id_col, text_col)), "bucket-totals")
    add = "aggregate({}, 0L, (a, x) -> a + x)"
    n_docs, n_target = (x or 0 for x in totals.agg(F.sum(F.expr(add.format("s"))), F.sum(F.expr(add.format("t")))).first())

    salts = math.ceil(4 * tasks / GROUPS)
    place = F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))  # partition and number: dealt in turn
    first = totals.select("g", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"), "s", "t")
    rest = blocks.where("g >= 0").select("g", F.pmod(place, F.lit(salts)).cast("int").alias("salt"), "block", "keys", "counts", *[F.lit(None).cast("array<long>").alias(c) for c in "st"])
    dealt = first.unionByName(rest).repartitionById(tasks, F.expr(f"CAST((g * {salts}L + salt) % {tasks} AS INT)")).sortWithinPartitions("g", "salt", F.col("block").asc_nulls_first())

    def contribute(batches):
        gain = None
        for batch in slices(batches, 64):
            names, out = [], []
            for r in batch.to_pylist():
                if r["block"] is None:
                    gain = gains(r["s"], r["t"], n_docs, n_target, n_buckets)
                else:
                    keys, n = np.cumsum(unpacked(r["keys"])), unpacked(r["counts"]) + 1
                    names.append(r["block"])
                    out.append(np.bincount(keys % BLOCK, n * gain[keys // BLOCK]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["block", "sums"])

    parts = dealt.select("block", "keys", "counts", "s", "t").mapInArrow(contribute, "block long, sums binary")
    listed = blocks.where("g < 0").select("block", F.lit(None).cast("binary").alias("sums"), "ids", "words")
    met = listed.unionByName(parts.select("block", "sums", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("words"))).repartitionById(tasks, F.pmod(place, F.lit(tasks)).cast("int")).sortWithinPartitions("block", F.col("words").isNull())

    def reduced(batches):
        ids, n_words, held = None, None, None

        def rows():
            n = np.array([max(0, w - k) for k in range(max_run) for w in n_words], np.int64).reshape(max_run, -1).sum(0)
            columns = (ids, n_words, n, np.where(n > 0, held // np.maximum(n, 1), 0))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "n_words", "n_features", "weight"])

        for batch in slices(batches, 64):
            for r in batch.to_pylist():
                if r["words"] is not None:
                    if ids is not None:
                        yield rows()
                    ids, n_words = r["ids"], np.frombuffer(r["words"], "<i8")
                    held = np.zeros(len(ids), np.int64)
                else:
                    own = np.frombuffer(r["sums"], "<i8")
                    held[: len(own)] += own
        if ids is not None:
            yield rows()

    out = met.select("block", "sums", "ids", "words").mapInArrow(reduced, "doc_id long, n_words long, n_features long, weight long")
    out.settled_path = blocks.settled_path
    out.totals = totals
    return out


def noise(seed: int, doc_id="doc_id"):
    """Gumbel noise in thousandths, by the first 32 bits of a digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, **options) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (from 1; null where not drawn) of every document."""
    weighed = weights(docs, target, **options)
    scored = settle(weighed.withColumn("score", F.col("weight") + noise(seed)), "scores")
    discard(weighed, weighed.totals)
    n = scored.where(F.col("n_words") >= min_words).count()
    able = F.col("n_words") >= min_words
    numbered = number_rows(scored.withColumn("_place", F.monotonically_increasing_id()), [able.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_place")], "ranked")
    discard(scored)
    out = numbered.select("doc_id", "n_words", "n_features", "weight", "score", F.when(able & (F.col("at") < percent * n // 100), F.col("at") + 1).alias("rank"))
    out.settled_path = numbered.settled_path
    return out


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, with all their columns; documents that share an id are drawn together."""
    drawn = importance(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
    return docs.join(drawn, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumn("doc_id", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
b AS (SELECT coalesce({WORDS_SQL}, []) AS w FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
hashed AS (SELECT f, {crc_sql("f")} % 10000 AS k FROM (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)), {CRC_TABLE_SQL}),
dk AS (SELECT r, k FROM df JOIN hashed USING (f)),
n AS (SELECT (SELECT count(*) FROM df) AS s, (SELECT count(*) FROM bf) AS t),
sk AS (SELECT k, count(*) AS s FROM dk GROUP BY k),
tk AS (SELECT k, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY k),
g AS (SELECT sk.k, CAST(floor(1000 * ln((CAST(coalesce(tk.t, 0) AS DOUBLE) + 1) * (CAST(n.s AS DOUBLE) + 10000) / ((CAST(sk.s AS DOUBLE) + 1) * (CAST(n.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM n, sk LEFT JOIN tk USING (k)),
w AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dk JOIN g USING (k) GROUP BY r),
scored AS (SELECT doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('7:' || doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (r)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM ranked) THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
