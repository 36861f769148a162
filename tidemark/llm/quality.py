"""Quality rules of documents, and of the hosts they come from.

Texts are measured where they are read: words, characters in words, symbols, repeated lines, and words in repeated 8-word
windows. Those are found exactly: two neighbouring words are numbered, then two neighbouring pairs, then two of those, and
only places whose halves both occur again go on.

Failures of each rule are counted by registered domain, added up on the map side. For each rule the domains' failures
follow a beta-binomial law around the rate over all documents; its strength comes from the data by the method of moments.
A domain is rejected if, for any rule, the lower bound of its posterior rate (mean less z deviations) exceeds max_rate,
so that neither few documents nor a bad stretch condemn it. Only rejected domains meet the documents again, by a join
that is broadcast when they are few (checked) and else shuffled, where Spark splits hot domains.

A source is a URL, whose host counts, or a name that stands for itself; upper-case A-Z are lower-cased.

Edge cases: null and empty texts have no words and fail; documents without a source are judged by their own rules only and
count for no domain; repeated ids and rows are judged row by row; without documents there are no verdicts; in
keep_good_documents all columns ride along, whatever their names, else further ones are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, broadcastable, discard, settle, slices, table, tidied
from .urlfilter import DOMAIN_SQL, domain_of, host_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
BLANKS = b" \t\n\x0b\x0c\r"
TO_BLANK = bytes(32 if b in BLANKS else b for b in range(256))
NOT_STARTS = BLANKS + bytes(range(0x80, 0xC0))  # blanks, and bytes that go on a code point
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
PIECE = 1 << 20
#: Rule to its condition of failure; the first two fail the document itself.
RULES = {
    "short": "n_words < 20",
    "repetitive": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
OWN = ("short", "repetitive")


def word_numbers(text: bytes, counter) -> np.ndarray:
    """A number for each word of a text, equal for equal words, from a counter that goes on from text to text."""
    known, out, at = defaultdict(counter.__next__), [], 0
    text = text.translate(TO_BLANK) if len(text) > PIECE else text
    while at < len(text):  # in pieces, so that the words of a long text don't stand in memory at once
        end = text.find(b" ", at + PIECE) if len(text) - at > PIECE else -1
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated(words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of 8 that its document has twice or more. Numbers of different documents differ."""
    n, width, rank = len(words), 1, words
    mask = np.zeros(n, bool)
    at = np.arange(max(0, n - 1))
    while width < WINDOW and len(at):
        at = at[docs[at] == docs[at + width]]
        pairs = rank[at] * (int(rank.max()) + 1) + rank[at + width]
        _, place, times = np.unique(pairs, return_inverse=True, return_counts=True)
        again = times[place] > 1
        rank = np.full(n, -1)
        rank[at[again]] = place[again]
        at, width = at[again], 2 * width
        if width < WINDOW:
            at = at[at + width < n]
            at = at[rank[at + width] >= 0]
    if len(at):
        edges = np.bincount(at, minlength=n + WINDOW) - np.bincount(at + WINDOW, minlength=n + WINDOW)
        mask = np.cumsum(edges)[:n] > 0
    return mask


def measured_batch(texts: list[bytes]) -> list[np.ndarray]:
    counter, rows = count(), []
    numbers = [word_numbers(t, counter) for t in texts]
    sizes = np.array([len(x) for x in numbers], np.int64)
    docs = np.repeat(np.arange(len(texts)), sizes)
    again = np.bincount(docs, repeated(np.concatenate(numbers), docs), len(texts)).astype(np.int64) if len(texts) else sizes
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        rows.append((len(t.translate(None, NOT_STARTS)), len(t) - len(t.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines))))
    return [sizes, *np.array(rows, np.int64).reshape(-1, 4).T, again]


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep as _0, _1, ... and the measures (long)."""
    names = list(dict.fromkeys([*keep, text_col]))
    source = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])
    source = source.withColumn(f"_{names.index(text_col)}", F.col(f"_{names.index(text_col)}").cast("string"))
    schema = T.StructType([*source.schema.fields[: len(keep)], *[T.StructField(m, T.LongType()) for m in MEASURES]])
    place, kept = names.index(text_col), len(keep)

    def run(batches):
        for batch in slices(batches, 64):
            found = measured_batch([x or b"" for x in batch.column(place).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *[pa.array(x, pa.int64()) for x in found]], schema.names)

    return source.mapInArrow(tidied(run), schema)


def source_domain(source):
    """The registered domain of a URL's host, or of a name; null without a source."""
    named = F.when(source.contains("://"), host_of(source)).otherwise(ascii_lower(source))
    return domain_of(named)


def domain_verdicts(judged: DataFrame, rules=RULES, max_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """domain, rule, n, k, rate (posterior mean), bound, of judged documents (domain and the measures). discard() of it deletes the counts it reads."""
    counts = settle(judged.where("domain IS NOT NULL").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.expr(f), 1).otherwise(0)).alias(f"k_{r}") for r, f in rules.items()]), "rule-failures")
    totals = counts.agg(F.sum("n").alias("n"), *[F.sum(f"k_{r}").alias(r) for r in rules]).first()
    rates = {r: (totals[r] / totals.n if totals.n else 0.0) for r in rules}
    spread = {r: max(p * (1 - p), 0.0) for r, p in rates.items()}
    excess = [F.sum(F.pow(F.col(f"k_{r}") - F.col("n") * rates[r], 2) / spread[r] - F.col("n")).alias(r) for r in rules if spread[r] > 0]
    moments = counts.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("_pairs"), *excess).first()
    each = []
    for r in rules:
        rho = moments[r] / moments._pairs if spread[r] > 0 and moments._pairs else 0.001
        strength = 1 / min(0.999, max(0.001, rho)) - 1
        a, b = F.col(f"k_{r}") + strength * rates[r], F.col("n") - F.col(f"k_{r}") + strength * (1 - rates[r])
        each.append(F.struct(F.lit(r).alias("rule"), F.col(f"k_{r}").alias("k"), (a / (a + b)).alias("rate"), (a / (a + b) - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))).alias("bound")))
    out = counts.select("domain", "n", F.explode(F.array(*each)).alias("x")).select("domain", "x.rule", "n", "x.k", "x.rate", "x.bound")
    out = out.withColumn("rejected", F.col("bound") > max_rate)
    out.settled_path = counts.settled_path
    return out


def rejected_domains(judged: DataFrame, **options) -> DataFrame:
    verdicts = domain_verdicts(judged, **options)
    out = settle(verdicts.where("rejected").select("domain").distinct().withColumn("_bad", F.lit(True)), "rejected-domains")
    discard(verdicts)
    return out


def failed(rules=RULES, own=OWN):
    """Whether a document fails the rules that it is held to itself."""
    return F.expr(" OR ".join(f"({rules[r]})" for r in own))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, domain, the measures, base_failed and kept, one row a document."""
    seen = measured(docs, [id_col, source_col], text_col).select(F.col("_0").alias("doc_id"), source_domain(F.col("_1").cast("string")).alias("domain"), *MEASURES)
    seen = settle(seen, "measures", "snappy")
    bad = rejected_domains(seen, **options)
    out = seen.withColumn("base_failed", failed()).join(broadcastable(bad), "domain", "left")
    out = out.select("doc_id", "domain", *MEASURES, "base_failed", (~F.col("base_failed") & F.col("_bad").isNull()).alias("kept"))
    out.settled_path = seen.settled_path
    return out


def keep_good_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents, with all their columns, that neither fail their own rules nor come from a rejected domain."""
    columns = docs.columns
    domain = source_domain(F.col(f"_{columns.index(source_col)}").cast("string"))
    seen = measured(docs, columns, text_col).withColumn("domain", domain)
    bad = rejected_domains(seen.select("domain", *MEASURES), **options)
    return seen.where(~failed()).join(broadcastable(bad), "domain", "left_anti").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("domain", "n_lines")


_WORD = r"[^\x20\x09-\x0D]"
_RULE_SQL = "SELECT '{r}' AS rule, domain, count(*) AS n, sum(CASE WHEN {f} THEN 1 ELSE 0 END) AS k FROM m WHERE domain IS NOT NULL GROUP BY domain"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{_WORD}+'), []) AS w FROM documents),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM (SELECT r, unnest(range(1, len(w) - 6)) AS i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM d)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM win WHERE c > 1) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
named AS (SELECT r, CASE WHEN contains(source, '://') THEN regexp_extract(source, '(?s)^.*?://([^/?#]*)', 1) ELSE source END AS name FROM d),
hosts AS (SELECT r, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM named),
m AS (SELECT r, doc_id, {DOMAIN_SQL} AS domain, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lines USING (r) JOIN hosts USING (r) LEFT JOIN rep USING (r)),
c AS ({" UNION ALL ".join(_RULE_SQL.format(r=r, f=f) for r, f in RULES.items())}),
p AS (SELECT rule, sum(k) / sum(n) AS p FROM c GROUP BY rule),
st AS (SELECT rule, p, 1 / least(0.999, greatest(0.001, coalesce(CASE WHEN p * (1 - p) > 0 THEN sum(pow(k - n * p, 2) / (p * (1 - p)) - n) / nullif(sum(n * (n - 1)), 0) END, 0.001))) - 1 AS s FROM c JOIN p USING (rule) GROUP BY rule, p),
post AS (SELECT domain, k + s * p AS a, n - k + s * (1 - p) AS b FROM c JOIN st USING (rule)),
bad AS (SELECT DISTINCT domain FROM post WHERE a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({") OR (".join(RULES[r] for r in OWN)}) AS base_failed,
  NOT (({") OR (".join(RULES[r] for r in OWN)})) AND bad.domain IS NULL AS kept
FROM m LEFT JOIN bad ON bad.domain = m.domain
"""
