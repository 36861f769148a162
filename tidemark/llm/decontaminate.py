"""Benchmark decontamination by a broadcast hash set of normalised test n-grams, in DataFrame functions only.

Texts become lists of word hashes. Hashes of windows of every needed length come from a few passes over
whole lists (a window of 10 words from two of 8 and 2, as 8 = 4 + 4), so no window is built word by word.
A bit table of the benchmark's windows, held as a constant, leaves few windows of each document; only
these become rows, with their words, and meet the broadcast hash set of windows in a hash join that
compares the words themselves. Each document has one more row that bears its number of words, so the
text is read once and only small rows are shuffled, by document.

The set of windows is written once and broadcast if its files are small (checked); beyond that it is joined by a
shuffle of the windows that the bit table leaves. A window that many items share is one entry of the set.
remove_contaminated looks for hits by two hashes of the text (128 bits), so that only hashes and spans are shuffled and
records stay where they are read.

Edge cases: null and empty texts have no words and are not contaminated; items of fewer words than the
window are one window, items without words none; repeated documents are judged row by row; repeated
item_ids count as one item; an empty benchmark leaves all documents clean; empty tables give empty
results; extra columns, whatever their names, ride along in remove_contaminated, else they are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcastable, discard, settle, table

#: On lower-cased text; RAW_GAP and RAW_WORD say the same of text as it is.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_GAP, RAW_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def joined(a: Column, b: Column, shift: int) -> Column:
    """Hash of a window from those of its first and second part: element i of a with element i + shift of b."""
    return F.zip_with(a, F.slice(b, shift + 1, F.greatest(F.size(b) - shift, F.lit(0))), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))


def with_hashes(df: DataFrame, lengths: list[int], words: str = "words") -> DataFrame:
    """Adds h<n> for each length: the hash of the n words from each position on, null near the end."""
    df = df.withColumn("h1", F.transform(words, lambda w: F.xxhash64(w)))
    powers = [1]
    while powers[-1] * 2 <= max(lengths):
        n = powers[-1]
        df = df.withColumn(f"h{2 * n}", joined(F.col(f"h{n}"), F.col(f"h{n}"), n))
        powers.append(2 * n)
    for n in sorted(set(lengths) - set(powers)):
        parts = [p for p in reversed(powers) if n & p]
        whole, size = F.col(f"h{parts[0]}"), parts[0]
        for p in parts[1:]:
            whole, size = joined(whole, F.col(f"h{p}"), size), size + p
        df = df.withColumn(f"h{n}", whole)
    return df


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """len int, gram (the words, joined by blanks), items: the distinct windows and which items hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("len", F.least(F.size("words"), F.lit(window)))
    grams = items.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1), lambda i: F.array_join(F.slice("words", i, F.col("len")), " "))).alias("gram"))
    return grams.groupBy("len", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def gram_hash(gram: Column, n: int) -> Column:
    """The hash that with_hashes gives the window."""
    parts, at, out = [p for p in (64, 32, 16, 8, 4, 2, 1) if n & p], 0, None
    words = F.split(gram, " ")

    def power(start: int, p: int) -> Column:
        return F.xxhash64(words[start]) if p == 1 else F.xxhash64(power(start, p // 2), power(start + p // 2, p // 2))

    for p in parts:
        out = power(at, p) if out is None else F.xxhash64(out, power(at, p))
        at += p
    return out


def bit_table(windows: DataFrame, lengths: list[int], n_words: int) -> Column:
    """A constant of n_words 64-bit words; bit (h & 63) of word ((h >> 6) mod n_words) is set for each window's hash h."""
    hashed = None
    for n in lengths:
        part = windows.where(F.col("len") == n).select(gram_hash(F.col("gram"), n).alias("h"))
        hashed = part if hashed is None else hashed.unionAll(part)
    found = hashed.groupBy(slot(F.col("h"), n_words).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))).alias("bits"))
    bits = [0] * n_words  # as many rows come back at most
    for at, value in found.collect():
        bits[at] = value
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")


def slot(h: Column, n_words: int) -> Column:
    return F.shiftright(h, 6).bitwiseAND(F.lit(n_words - 1)).cast("int")


def bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(63)).cast("int")


def passing(n: int, table_words: int) -> Column:
    """(pos, len, gram) of the windows of n words whose bit is set in the column bits."""

    def at(h, i):
        return F.when(h.isNotNull() & (F.getbit(F.get(F.col("bits"), slot(h, table_words)), bit(h)) == 1), i)

    def window(i):
        return F.struct((i + 1).alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice("words", i + 1, n), " ").alias("gram"))

    return F.transform(F.filter(F.transform(f"h{n}", at), lambda i: i.isNotNull()), window)


def find_hits(docs: DataFrame, windows: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    """c, a struct of the columns carry as c0, c1 ..., n_words long and hits: a sorted array of (pos, len, items), pos from 1; one row a document. windows are settled."""
    by_length = {r.len: r.n for r in windows.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # window rows at most
    lengths, n_windows = sorted(by_length), sum(by_length.values())
    carried = [f"c{i}" for i in range(len(carry))]
    based = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(x) for c, x in zip(carry, carried)], words_of(F.col(f"`{text_col}`")).alias("words"))
    if not lengths:
        return based.select(F.struct(*carried).alias("c"), F.size("words").cast("long").alias("n_words"), F.array().cast("array<struct<pos:int,len:int,items:array<string>>>").alias("hits"))
    table_words = 1 << min(16, max(13, math.ceil(math.log2(n_windows))))
    hashed = with_hashes(based, lengths).withColumn("bits", bit_table(windows, lengths, table_words))
    found = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit("").alias("gram")))  # the row that every document has
    for n in lengths:
        found = F.concat(found, passing(n, table_words))
    rows = hashed.select("row", *carried, F.size("words").cast("long").alias("n_words"), F.explode(found).alias("f"))
    rows = rows.select("row", *[F.when(F.col("f.len") == 0, F.col(x)).alias(x) for x in carried], "n_words", "f.pos", "f.len", "f.gram")
    met = rows.join(broadcastable(windows), ["len", "gram"], "left").where((F.col("len") == 0) | F.col("items").isNotNull())
    return met.groupBy("row").agg(
        F.max_by(F.struct(*carried), F.when(F.col("len") == 0, 1)).alias("c"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("len") > 0, F.struct("pos", "len", "items")))).alias("hits"),
    )


def merged(hits: Column) -> Column:
    """Disjoint spans (pos, stop) in order, of hits sorted by position; each hit lengthens the last span or opens one."""
    span = "array<struct<pos:int,stop:int>>"
    none = F.struct(F.array().cast(span).alias("done"), F.lit(None).cast("int").alias("pos"), F.lit(0).alias("stop"))

    def add(s, h):
        on = h["pos"] <= s["stop"]
        done = F.when(s["pos"].isNull() | on, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["pos"].alias("pos"), s["stop"].alias("stop"))).cast(span)))
        end = h["pos"] + h["len"]
        return F.struct(done.alias("done"), F.when(s["pos"].isNotNull() & on, s["pos"]).otherwise(h["pos"]).alias("pos"), F.greatest(s["stop"], end).alias("stop"))

    return F.aggregate(hits, none, add, lambda s: F.when(s["pos"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["pos"].alias("pos"), s["stop"].alias("stop"))).cast(span))))


def covered(hits: Column) -> Column:
    """Words inside any hit; hits are sorted by position."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).alias("upto")),
        lambda s, h: F.struct((s["n"] + F.greatest(F.lit(0), h["pos"] + h["len"] - F.greatest(s["upto"], h["pos"]))).cast("long").alias("n"), F.greatest(s["upto"], h["pos"] + h["len"]).alias("upto")),
        lambda s: s["n"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item_ids), spans (word positions from 1 and lengths)."""
    windows = settle(benchmark_windows(benchmark, window), "windows")
    found = find_hits(docs, windows, [id_col], text_col)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    out = found.select(F.col("c.c0").alias("doc_id"), "n_words", covered(F.col("hits")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), h["len"].alias("len"))).alias("spans"))
    out = settle(out, "decontaminated", "snappy")
    discard(windows)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The columns of docs. Documents of which min_share of the words or more are hit go; from others the hit words go.

    Words are removed from the text itself, with the separators before each; what is left keeps its letters' case.
    """
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    windows = settle(benchmark_windows(benchmark, window), "windows")
    found = find_hits(keyed, windows, ["k1", "k2"], "text").where(F.size("hits") > 0)
    found = found.select(F.col("c.c0").alias("h1"), F.col("c.c1").alias("h2"), "n_words", covered(F.col("hits")).alias("n_hit"), merged(F.col("hits")).alias("spans"))
    found = settle(found.dropDuplicates(["h1", "h2"]), "contaminated")
    discard(windows)
    met = keyed.join(broadcastable(found), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    met = met.where(F.col("spans").isNull() | (F.col("n_hit") < min_share * F.col("n_words")))
    pieces = F.regexp_extract_all("text", F.lit(f"({RAW_GAP}*{RAW_WORD}+)"), F.lit(1))
    tail = F.regexp_extract("text", f"({RAW_GAP}*)$", 1)
    stops = F.concat(F.array(F.lit(1)), F.transform("spans", lambda s: s["stop"]))
    starts = F.concat(F.transform("spans", lambda s: s["pos"]), F.array(F.size("pieces") + 1))
    kept = F.flatten(F.zip_with(stops, starts, lambda a, b: F.slice(F.col("pieces"), a, b - a)))
    met = met.withColumn("pieces", F.when(F.col("spans").isNotNull(), pieces))
    left = F.when(F.col("spans").isNotNull(), F.concat(F.array_join(kept, ""), tail)).otherwise(F.col("text"))
    kind = docs.schema[text_col].dataType
    return met.select(*[left.cast(kind).alias(c) if c == text_col else F.col("rec").getField(c).alias(c) for c in docs.columns])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS gram FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
q AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT r, p, n, item FROM q JOIN g USING (n, gram)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
