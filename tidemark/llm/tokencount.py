"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

The vocabulary (a sentencepiece BPE model) never merges across the start of a run of blanks: no piece
holds a blank after another character. A text is therefore the concatenation of pre-tokens "blanks then
non-blanks" whose counts add up, once the model's own leading blank is put in front.

Tier 1 is a compact table of the lengths (in tokens) of frequent pre-tokens. Each task summarises all of
its rows with a Misra-Gries counter of at most ``per_task`` entries, one row that is written to the shared folder;
tasks that read some of these rows each merge them into one, again and again until few are left, so no row is dealt by
word. The ``frequent`` heaviest pre-tokens of at most ``max_bytes`` bytes are encoded and broadcast: under
frequent * (max_bytes + 2) bytes whatever the corpus. Tier 2 is a bounded cache in every Python worker; what is in neither is
encoded. The tables only save time: any pre-token gets the count that the model gives.

Edge cases: a null text counts as empty; the empty text has no token; special strings are ordinary text,
as in the library; very long pre-tokens are encoded but not cached; rows repeat freely; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, discard, settle, slices, table, text_or_empty, worker_cache

MODEL = "piece_bpe_32k.model"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def load_model(path: str):
    """The model, once a worker; checks what the split into pre-tokens rests on."""
    cache = worker_cache()
    if ("sp", path) not in cache:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())) or sp.encode("  a b", out_type=str)[0][0] != "▁" or sp.encode("ﬁ") == sp.encode("fi"):
            raise ValueError("this model normalises text or merges across blanks; count whole texts instead")
        cache["sp", path] = sp
    return cache["sp", path]


RUNS = re.compile(" *[^ ]+| +")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without the first blank of each: encode() puts it back. U+2581 is the model's blank."""
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " in text or text[-1:] == " " or text[:1] == " ":
        return [x[1:] for x in RUNS.findall(" " + text)]
    return text.split(" ") if text else []


def count_one(sp, word: str) -> int:
    """Tokens of a pre-token, given without its first blank. The library gives no token for an empty text, where there is one blank here."""
    if word:
        return len(sp.encode(word))
    return len(sp.encode("a b")) - len(sp.encode("a")) - len(sp.encode("b")) + 1


SUMMARY = "words array<string>, counts array<long>"
#: Summaries that one task merges.
FAN_IN = 64


def lowered(seen, capacity: int):
    """A Misra-Gries counter with at most capacity / 2 entries left, each less by what the greatest one dropped had."""
    from collections import Counter

    floor = sorted(seen.values(), reverse=True)[capacity // 2]
    return Counter({w: n - floor for w, n in seen.items() if n > floor})


def summary(seen, per_task: int) -> pa.RecordBatch:
    kept = seen.most_common(per_task)
    return pa.RecordBatch.from_arrays([pa.array([[w for w, _ in kept]], pa.list_(pa.string())), pa.array([[n for _, n in kept]], pa.list_(pa.int64()))], ["words", "counts"])


def frequent_words(texts: DataFrame, top: int, per_task: int, capacity: int, max_bytes: int) -> list[str]:
    """The heaviest pre-tokens over all rows, from one Misra-Gries summary a task."""
    from collections import Counter

    def summarise(batches):
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(text.split(" "))
            while len(seen) > capacity:
                seen = lowered(seen, capacity)
        if seen:
            yield summary(Counter({w: n for w, n in seen.items() if len(w.encode()) <= max_bytes}), per_task)

    def merge(batches):
        seen: Counter = Counter()
        for batch in slices(batches, 1):
            for words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                for w, n in zip(words, counts):
                    seen[w] += n
            while len(seen) > capacity:
                seen = lowered(seen, capacity)
        if seen:
            yield summary(seen, 2 * per_task)

    now = settle(texts.mapInArrow(summarise, SUMMARY), "summaries", "zstd")
    while (rows := now.count()) > FAN_IN:
        fewer = settle(now.coalesce(-(-rows // FAN_IN)).mapInArrow(merge, SUMMARY), "summaries", "zstd")
        discard(now)
        now = fewer
    seen: Counter = Counter()
    for r in now.toLocalIterator():  # FAN_IN rows at most
        for w, n in zip(r.words, r.counts):
            seen[w] += n
    discard(now)
    return [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:top]]


def count_tokens(docs: DataFrame, model_path: str, frequent: int = 32_768, per_task: int = 8_192, capacity: int = 131_072, max_bytes: int = 48, cache_words: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, n_bytes long, n_tokens long; no begin or end tokens. cache_words bounds tier 2."""
    spark = docs.sparkSession
    texts = docs.select(text_or_empty(text_col).alias("text"))
    words = frequent_words(texts, frequent, per_task, capacity, max_bytes)
    sp = load_model(model_path)
    lengths = bytes(min(255, count_one(sp, w)) for w in words)
    shared = spark.sparkContext.broadcast(("\n".join(w if "\n" not in w else "" for w in words), lengths))

    def count(batches):
        cache = worker_cache()
        sp = load_model(model_path)
        key = ("token lengths", hash(shared.value))
        if key not in cache:
            for old in [k for k in cache if k[0] in ("token lengths", "misses")]:
                del cache[old]
            cache[key] = {w: n for w, n in zip(shared.value[0].split("\n"), shared.value[1]) if n < 255 and w}
            cache["misses", 0] = {}
        hot, misses = cache[key], cache["misses", 0]
        blank = count_one(sp, "")
        for batch in slices(batches):
            ids, sizes, out = batch.column(0), [], []
            for text in batch.column(1).to_pylist():
                sizes.append(len(text.encode()))
                total = 0
                for w in pre_tokens(text):
                    n = hot.get(w) or misses.get(w)
                    if n is None:
                        n = count_one(sp, w) if w else blank
                        if len(w) <= max_bytes:
                            if len(misses) >= cache_words:
                                misses.clear()
                            misses[w] = n
                    total += n
                out.append(total)
            yield batch_of(SCHEMA, ids, sizes, out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)
