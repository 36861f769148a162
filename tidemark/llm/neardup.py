"""Near-duplicate documents by HyperMinHash: compressed min-hash registers, banded, estimated, verified.

A document is the set of its distinct n-word shingles, hashed to 64 bits. The hash's upper bits choose
one of 128 buckets; of a bucket's least value the count of leading zeros (6 bits) and the 10 bits after
the leading one are stored, 2 bytes a bucket. An empty bucket takes the register of another, chosen by a
fixed random order, so that a register of two sets agrees with the probability of their Jaccard
similarity J. 32 bands of 4 registers meet with probability 1 - (1 - J^4)^32, all but 5e-8 at J = 0.8.

1. Documents with equal sets are one node, known by a 128-bit fingerprint of the set.
2. Band keys that occur once are dropped: the keys alone are counted, and the rows of shared keys are kept.
   Nodes that share a key meet in its bucket. Each is compared with the bucket's least node: a star, not
   all pairs. The estimate, corrected for registers that agree by chance, drops pairs that are more than
   five deviations below the threshold; the others are confirmed on their full shingle sets.
3. Confirmed links give components. Buckets that still hold several components are searched for every
   pair across components (pairs within one can't change it), estimated and confirmed likewise.
   No bucket has a cap, so links are lost only where no band meets.

Texts of nodes that meet another are fetched from docs; no other text is moved. Tables of nodes are broadcast
while they are small (checked), else joined by a shuffle whose hot keys Spark splits; the driver sees no
documents, links or components.

Edge cases: a text with fewer than n words is one shingle; without words, or null, the set is empty and
linked with nothing; rows that share a doc_id are one document, linked by any of its texts; rows with a null
doc_id are returned unlinked with a null component and kept; an empty table gives an empty result; extra
columns are ignored by near_duplicates and ride along in drop_near_duplicates.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcastable, discard, discard_all, few_tasks, free_shuffles, row_key, settle, slices, table, text_slices, tidied
from .components import components, crowded_pairs, link_collisions
from .shingles import mixed, shingle_set, similar_pairs, word_hashes

BUCKET_BITS, MANTISSA_BITS, BANDS, ROWS = 7, 10, 32, 4
BUCKETS = 1 << BUCKET_BITS
#: For each bucket the order in which others lend it a register.
LENDERS = np.stack([np.random.default_rng(1000 + i).permutation(BUCKETS) for i in range(BUCKETS)]).astype(np.uint8)
PRINTS = "doc_id long, rid long, n int, fp1 long, fp2 long, regs binary"
FP = ["fp1", "fp2"]
#: Rows of a key, copies included, from which they are not gathered in one task before copies have become one.
HOT = 1 << 16


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 compressed registers (leading zeros and mantissa) of a sorted set of hashes that isn't empty."""
    at = np.searchsorted(hashes, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    full = at < len(hashes)
    full[full] = bucket[at[full]] == np.flatnonzero(full)
    rest = hashes[np.where(full, at, 0)] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)
    mantissa, exponent = np.frexp((rest >> np.uint64(4)).astype(np.float64))
    zeros = np.where(rest >> np.uint64(4) > 0, 53 - exponent, 53)
    regs = (zeros << MANTISSA_BITS | ((np.maximum(mantissa, 0.5) * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)).astype(np.uint16)
    empty = np.flatnonzero(~full)
    if len(empty):
        regs[empty] = regs[LENDERS[empty, full[LENDERS[empty]].argmax(1)]]
    return regs


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys from (documents, BUCKETS) registers: each band's four registers fill 64 bits."""
    packed = np.ascontiguousarray(regs).view(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(packed + mixed(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, less what agrees by chance in sets that share nothing."""
    agree = (regs_a == regs_b).mean(1)
    level = 0.5 ** np.arange(64)
    chance = [np.diff(-((1 - level)[None, :] ** np.maximum(n / BUCKETS, 1)[:, None]), axis=1, append=-1) for n in (n_a, n_b)]
    by_luck = np.abs(chance[0] * chance[1]).sum(1) / (1 << MANTISSA_BITS)
    return (agree - by_luck) / (1 - by_luck)


def prints(texts: DataFrame, n: int) -> DataFrame:
    """doc_id, rid, set size, fingerprint and registers of every text of (doc_id, rid, text)."""

    def make(batches):
        import xxhash

        hashes = word_hashes()
        for batch in slices(batches):
            sizes, fp1, fp2, regs = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set((text or "").encode(), n, hashes)
                fp = xxhash.xxh3_128_intdigest(s.tobytes())
                sizes.append(len(s))
                fp1.append((fp >> 64) - (1 << 63))
                fp2.append((fp & ((1 << 64) - 1)) - (1 << 63))
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "rid", "n", "fp1", "fp2", "regs"])

    return texts.select("doc_id", "rid", "text").mapInArrow(tidied(make), PRINTS)


#: The low byte of every register, eight to a column.
SIGNS = tuple(f"s{i}" for i in range(BUCKETS // 8))


def register_bytes(nodes: DataFrame) -> DataFrame:
    """id, n and SIGNS of nodes (id, n, regs)."""

    def take(batches):
        for batch in slices(batches, 2048):
            if batch.num_rows:
                low = np.ascontiguousarray(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS).astype(np.uint8)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(low[:, i])) for i in range(low.shape[1])]], ["id", "n", *SIGNS])

    return nodes.select("id", "n", "regs").mapInArrow(take, "id long, n int, " + ", ".join(f"{s} long" for s in SIGNS))


def equal_bytes(a, b):
    """How many of the eight bytes of two integers are equal."""
    x = a.bitwiseXOR(b)
    for shift in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return 8 - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def agree_enough(percent: int):
    """As many register bytes agree as a pair at the threshold has, less 4.5 deviations; registers that small sets lend out count as few."""
    same = sum((equal_bytes(F.col(f"{s}_a"), F.col(f"{s}_b")) for s in SIGNS), F.lit(0))
    p = percent / 100
    full = BUCKETS * (1 - F.exp(-F.least("n_a", "n_b") / F.lit(float(BUCKETS))))
    return same >= BUCKETS * (p - 4.5 * F.sqrt(p * (1 - p) / full))


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose registers allow the similarity: the estimate is at most five deviations below it."""
    low = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / BUCKETS) ** 0.5
    sides = [nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab"]

    def prune(batches):
        for batch in slices(batches, 4096):
            if batch.num_rows:
                regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in (3, 5)]
                sizes = [np.asarray(batch.column(c)).astype(np.float64) for c in (2, 4)]
                yield batch.filter(pa.array(estimate(*regs, *sizes) >= low)).select([0, 1])

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "regs_a", "n_b", "regs_b").mapInArrow(prune, "a long, b long")


def mean_bytes(quoted: DataFrame) -> int:
    """Of the texts of a settled table, 64 more for the rest of a row."""
    return 64 + int(quoted.agg(F.avg(F.octet_length("text"))).first()[0] or 0)


def confirmed(pairs: DataFrame, quoted: DataFrame, n: int, percent: int, name: str, allow=None, whole: bool = False) -> DataFrame:
    """Pairs (a, b) of ids of quoted (id, text) whose full shingle sets have the similarity, and with whole as many of their places. b is the side that may recur without bound."""
    pairs = settle(pairs, f"{name}-pairs")
    rows, size = pairs.count(), mean_bytes(quoted)
    sides = [quoted.select(*[F.col(c).alias({"id": x}.get(c, f"{c}_{x}")) for c in quoted.columns]) for x in "ab"]

    def verify(batches):
        for batch in text_slices(batches, 2, 3):
            keep = similar_pairs(batch.column(2), batch.column(3), np.asarray(batch.column(1)), n, percent, whole)
            yield batch.filter(pa.array(keep)).select([0, 1])

    left = few_tasks(pairs.join(sides[0], "a"), rows, size)
    met = left.join(sides[1], "b")
    if allow is not None:
        met = met.where(allow)
    return settle(few_tasks(met, rows, 2 * size).select("a", "b", "text_a", "text_b").mapInArrow(tidied(verify), "a long, b long"), f"{name}-links")


def shared_keys(keys: DataFrame, name: str) -> DataFrame:
    """The keys that occur more than once, and how often (c): all that is shuffled of the others is the key."""
    return settle(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), f"{name}-shared")


def met_nodes(keyed: DataFrame, shared: DataFrame, name: str, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """met (key, fp1) of the keys that several nodes of keyed (key, fp1) share, and the fp1 of those nodes; both settled.

    Half of a fingerprint is moved: nodes that have it in common are still told apart by the whole one when they get their
    ids, and one more of them under a key only makes pairs that are not confirmed. A key that no others share is missed
    if two nodes agree in that half, with odds of 2^-64 a pair. Shared keys grow with the texts, so that keyed is
    shuffled at every size; the few keys of hot rows or more are broadcast, and their copies become one where they are read.
    """
    free_shuffles(keyed.sparkSession)
    often = settle(few_tasks(shared.where(F.col("c") >= hot).select("key"), 1), f"{name}-often")
    crowds = not often.isEmpty()
    rest = keyed.join(broadcastable(often), "key", "left_anti") if crowds else keyed
    met = rest.join(shared.where(F.col("c") < hot).select("key").hint("merge"), "key").select("key", "fp1").distinct()
    if crowds:
        met = met.unionAll(keyed.join(broadcastable(often), "key").select("key", "fp1").distinct())
    met = settle(met, f"{name}-several")
    free_shuffles(keyed.sparkSession)
    several = met.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    out = settle(met.join(several, "key"), f"{name}-keyed")
    discard(met, shared)
    return out, settle(few_tasks(out.select("fp1").distinct(), out.count()), f"{name}-nodes")


def numbered(firsts: DataFrame, name: str, codec: str = "uncompressed") -> DataFrame:
    """firsts (fp1, fp2, p and others) with id, in order of p, the node's first place: copies mostly follow what they were made from, so it becomes the centre of the star."""
    return settle(firsts.orderBy("p").withColumn("id", F.monotonically_increasing_id()), name, codec)


def with_least(met: DataFrame, told: DataFrame, rows: int, name: str) -> DataFrame:
    """met (key, id) with the columns of told (id, n and others), and low and n_low, the least node of the key."""
    whole = settle(few_tasks(met.join(broadcastable(told), "id"), rows), f"{name}-told")
    least = few_tasks(whole.groupBy("key").agg(F.min(F.struct("id", "n")).alias("m")), rows).select("key", F.col("m.id").alias("low"), F.col("m.n").alias("n_low"))
    out = settle(few_tasks(whole.join(least, "key"), rows), f"{name}-met")
    discard(whole)
    return out


def one_document(pairs: DataFrame, name: str) -> DataFrame:
    """doc_id, component_id from pairs (doc_id, least): a document with texts in several groups makes them one."""
    pairs = settle(pairs, f"{name}-places")
    clash = pairs.groupBy("doc_id").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi").select("doc_id", "lo")
    edges = settle(pairs.join(clash, "doc_id").select(F.col("least").alias("a"), F.col("lo").alias("b")).where("a > b").distinct(), f"{name}-clashes")
    if edges.isEmpty():
        return pairs.select("doc_id", F.col("least").alias("component_id")).distinct()
    merged = components(edges, "a", "b", f"{name}-merged")
    return pairs.join(merged, F.col("least") == F.col("id"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "least")).alias("component_id"))


def search(docs: DataFrame, n: int, percent: int, run: str) -> tuple[DataFrame, DataFrame]:
    """doc_id and n of every row of docs (doc_id, text), and doc_id, component_id of documents that are linked with others. Both are settled under run."""
    texts = docs.select("doc_id", row_key().alias("rid"), "text")
    printed = settle(prints(texts, n), f"{run}-prints")
    sets = printed.where("n > 0 AND doc_id IS NOT NULL")

    def bands(batches):
        for batch in slices(batches, 2048):
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))], ["key", "fp1"])

    keyed = sets.select("fp1", "regs").mapInArrow(bands, "key long, fp1 long")
    met, nodes = met_nodes(keyed, shared_keys(keyed.select("key"), run), run)
    rows = met.count()
    firsts = sets.join(broadcastable(nodes), "fp1").groupBy(*FP).agg(F.min(F.struct("doc_id", "rid")).alias("p"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    told = numbered(firsts, f"{run}-known")
    ids = settle(told.select("id", *FP), f"{run}-ids")
    met = met.join(broadcastable(ids), "fp1").select("key", "id")
    place = settle(told.select("id", "p.rid", "p.doc_id"), f"{run}-place")
    quoted = settle(texts.join(broadcastable(place), ["rid", "doc_id"]).select("id", "text").dropDuplicates(["id"]), f"{run}-quoted", "zstd")
    signed = with_least(met, settle(register_bytes(told), f"{run}-signs"), rows, run)

    def confirm(pairs: DataFrame, at: str) -> DataFrame:
        return confirmed(estimated(pairs, told, percent), quoted, n, percent, f"{run}-{at}")

    final = link_collisions(signed, percent, confirm, run, quoted, n, SIGNS, agree_enough(percent), lambda many, name: crowded_pairs(many, quoted, percent, n, name))
    linked = settle(final.join(broadcastable(ids), "id").select(*FP, F.col("component").alias("c")), f"{run}-linked")
    # groups: components of several sets, and single sets; those of one document need no row
    placed = sets.select("doc_id", *FP).join(broadcastable(linked), FP, "left")
    group = [F.when(F.col("c").isNull(), F.col("fp1")).alias("g1"), F.when(F.col("c").isNull(), F.col("fp2")).alias("g2"), "c"]
    groups = placed.select("doc_id", *group).groupBy("g1", "g2", "c").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    groups = broadcastable(settle(groups, f"{run}-groups"))
    pairs = placed.join(groups.where("c IS NULL").select(F.col("g1").alias("fp1"), F.col("g2").alias("fp2"), "least"), FP).select("doc_id", "least")
    pairs = pairs.unionAll(placed.join(groups.where("c IS NOT NULL").select("c", "least"), "c").select("doc_id", "least"))
    return printed.select("doc_id", "n"), settle(one_document(pairs.distinct(), run), f"{run}-placed")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles long, component_id (the least doc_id reachable), kept boolean; one row a row of docs."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    run = f"neardup_{uuid.uuid4().hex}"
    sets, placed = search(base, n, percent, run)
    known = sets.where("doc_id IS NOT NULL").join(broadcastable(placed), "doc_id", "left").unionAll(sets.where("doc_id IS NULL").select("doc_id", "n", F.lit(None).cast("long")))
    component = F.coalesce("component_id", "doc_id")
    out = settle(known.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "near-duplicates")
    discard_all(docs.sparkSession, run)
    return out


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which near_duplicates keeps the document: of each group the document of least id; rows without a set stay."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    run = f"neardup_{uuid.uuid4().hex}"
    _, placed = search(base, n, percent, run)
    gone = settle(placed.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")), "near-duplicates-gone")
    discard_all(docs.sparkSession, run)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"), F.col(f"`{id_col}`").cast("long").alias("id"))
    kept = keyed.where("id IS NOT NULL").join(broadcastable(gone), F.col("id") == F.col("gone"), "left_anti").unionAll(keyed.where("id IS NULL"))
    return kept.select(*[F.col("rec").getField(c).alias(c) for c in docs.columns])


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(w) = 1 THEN w[1] ELSE w[p] || ' ' || w[p + 1] END AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w), 2))) AS p FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
t AS MATERIALIZED (SELECT s.r, s.g, n.n FROM s JOIN n USING (r)),
k AS (SELECT x.r AS a, y.r AS b, count(*) AS m, any_value(x.n) AS na, any_value(y.n) AS nb FROM t x JOIN t y ON x.g = y.g AND x.r < y.r AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM k WHERE 100 * m >= 80 * (na + nb - m)),
e AS MATERIALIZED (SELECT u.doc_id AS a, v.doc_id AS b FROM l JOIN w u ON u.r = l.a JOIN w v ON v.r = l.b UNION SELECT v.doc_id, u.doc_id FROM l JOIN w u ON u.r = l.a JOIN w v ON v.r = l.b),
c AS (SELECT DISTINCT doc_id AS id, doc_id AS root FROM w WHERE doc_id IS NOT NULL UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id),
m AS (SELECT id, min(root) AS component_id FROM c GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, coalesce(w.doc_id = m.component_id, true) AS kept FROM w LEFT JOIN n USING (r) LEFT JOIN m ON m.id = w.doc_id
"""
