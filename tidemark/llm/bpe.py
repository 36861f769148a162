"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Documents are read in blocks of bounded size. A block keeps the sequence of its pre-tokens as
   positions into the list of its distinct pre-tokens, and is written to the shared folder, bucketed by
   block number.
2. The blocks' distinct pre-tokens are exploded into groups by a hash of the word, each group sorted and
   packed, and dealt by group, so all copies of a word meet in one task, which goes through its groups one
   after the other: each distinct word is encoded once. There are as many groups as input partitions or
   more, so what a task holds, the words of one group, doesn't grow with the corpus. A word comes from a
   block once at most, so the commonest word weighs no more than there are blocks.
3. The ids are dealt back by block, meet the block's sequence (which is not shuffled again, being bucketed
   by the same key) and are put in order of position.

Decoding joins every id with the token-byte table, a map-side hash join on a dense key: the vocabulary bounds
the table, each task holds it as two arrays, and the key is the place.

encode's result reads the blocks in the shared folder; discard() of it deletes them when it has been used.

Edge cases: a null text is encoded as empty; the empty text has no ids; a pre-token may be as long as the
text; null and repeated doc_ids are kept row by row; special strings are ordinary text; an empty table
gives an empty result; extra columns are ignored. Ids outside the vocabulary raise an error in decoding.
"""

from __future__ import annotations

import base64
import uuid
from itertools import count as counter
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, settle, shared_dir, slices, table, text_or_empty, tidy, worker_cache

RANKS = "byte_bpe_50k.tiktoken"
BLOCKS = "block long, doc_ids array<bigint>, counts array<int>, codes binary, order binary, groups array<struct<g:int,words:binary>>"
#: Ends a pre-token in a packed group; no UTF-8 text holds this byte.
END = b"\xff"
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
#: A vocabulary may have so many entries to be held by every task.
MAX_VOCABULARY = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoder(path: str, pattern: str):
    cache = worker_cache()
    if ("bpe", path) not in cache:
        import tiktoken

        cache["bpe", path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return cache["bpe", path]


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all bytes end to end, and where each id starts."""
    cache = worker_cache()
    if ("token bytes", path) not in cache:
        ranks = read_ranks(path)
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError("the vocabulary is too large to be held by every task")
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        cache["token bytes", path] = np.frombuffer(b"".join(by_id), np.uint8), np.cumsum([0, *map(len, by_id)])
    return cache["token bytes", path]


def gather(flat: np.ndarray, starts: np.ndarray, which: np.ndarray, step: int = 1 << 18) -> bytes:
    """flat[starts[i]:starts[i + 1]] for each i of which, end to end."""
    out = []
    for at in range(0, len(which), step):
        some = which[at : at + step]
        first, lens = starts[some], starts[some + 1] - starts[some]
        ends = np.cumsum(lens)
        out.append(flat[np.repeat(first - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
    return b"".join(out)


def planes(codes: list[np.ndarray]) -> bytes:
    """All codes, low bytes first, then the next, and so on: as many planes as are needed, which compress better than whole integers."""
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    n = max(1, (int(flat.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4)[:, :n].T).tobytes()


def from_planes(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 4), np.uint8)
    if size:
        own = np.frombuffer(data, np.uint8).reshape(-1, size)
        out[:, : len(own)] = own.T
    return out.view(np.int32).ravel()


def cut_blocks(docs: DataFrame, pattern: str, block_bytes: int, groups: int) -> DataFrame:
    """Blocks of documents: sequences of positions (codes) in each block's own list of distinct pre-tokens; order has the codes as they stand in groups."""

    def cut(batches):
        import xxhash
        import regex
        from pyspark import TaskContext

        split, part, made = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        ids, counts, codes, size, words = [], [], [], 0, None

        def block():
            dealt = defaultdict(list)
            for word, code in words.items():
                word = word.encode()
                dealt[xxhash.xxh3_64_intdigest(word) % groups].append((word, code))
            order, packed = [], []
            for g in sorted(dealt):
                own = sorted(dealt.pop(g))
                order += [c for _, c in own]
                packed.append({"g": g, "words": END.join(w for w, _ in own)})
            columns = [([part << 32 | made], pa.int64()), ([ids], pa.list_(pa.int64())), ([counts], pa.list_(pa.int32())), ([planes(codes)], pa.binary()), ([np.array(order, np.int32).tobytes()], pa.binary()), ([packed], pa.list_(pa.struct([("g", pa.int32()), ("words", pa.binary())])))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["block", "doc_ids", "counts", "codes", "order", "groups"])

        for batch in slices(batches, 64):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words is None:
                    words = defaultdict(counter().__next__)
                found = split(text)
                ids.append(doc_id)
                counts.append(len(found))
                codes.append(np.array(list(map(words.__getitem__, found)), np.int32))
                size += len(text) + 64
                if size >= block_bytes:
                    yield block()
                    made += 1
                    ids, counts, codes, size, words = [], [], [], 0, None
                    tidy()
        if ids:
            yield block()
        del ids, counts, codes, words
        tidy()

    return docs.mapInArrow(cut, BLOCKS)


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, n_tokens long, ids binary (little-endian unsigned 32-bit integers), one row a document."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(f"`{text_col}`").alias("text"))
    n_in = texts.rdd.getNumPartitions()
    n, tasks = min(20_000, max(8, 2 * n_in)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(tasks, n_in)
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    cut_blocks(texts, pattern, block_bytes, groups).write.option("compression", "zstd").option("path", path).bucketBy(n, "block").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    kind = np.uint16 if len(read_ranks(ranks_path)) <= 1 << 16 else np.uint32

    def encode_words(batches):
        enc, known, group = encoder(ranks_path, pattern), {}, None
        for batch in slices(batches, 64):
            lens, ids = [], []
            for g, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if g != group:
                    known, group = {}, g
                found = []
                for word in packed.split(END):
                    if (tokens := known.get(word)) is None:
                        tokens = known[word] = np.array(enc._encode_single_piece(word), kind).tobytes()
                    found.append(tokens)
                lens.append((np.array(list(map(len, found)), np.uint32) // np.dtype(kind).itemsize).astype(np.uint32).tobytes())
                ids.append(b"".join(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lens, pa.binary()), pa.array(ids, pa.binary())], ["block", "g", "lens", "ids"])

    words = blocks.select("block", F.explode("groups").alias("p")).select("block", "p.g", "p.words").repartitionById(tasks, F.pmod("g", F.lit(tasks))).sortWithinPartitions("g")
    encoded = words.mapInArrow(encode_words, "block long, g int, lens binary, ids binary").repartition(n, "block")
    by_block = encoded.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("g", "lens", "ids"))).alias("map"))

    def assemble(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, counts, codes, order, dealt = (column[r].as_py() for column in batch.columns)
                codes, order = from_planes(codes, sum(counts)), np.frombuffer(order, np.int32)
                lens = np.frombuffer(b"".join(x["lens"] for x in dealt or ()), np.uint32)
                flat = np.frombuffer(b"".join(x["ids"] for x in dealt or ()), kind).astype(np.uint32)
                starts = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))  # where a code's ids stand
                at, ids, n_tokens, out, size = 0, [], [], [], 0
                for doc_id, n_words in zip(doc_ids, counts):
                    ids.append(doc_id)
                    out.append(gather(flat, starts, place[codes[at : at + n_words]]))
                    n_tokens.append(len(out[-1]) // 4)
                    at += n_words
                    size += len(out[-1])
                    if size >= 4 << 20 or at == len(codes):
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(out, pa.binary())], schema=ENCODED)
                        ids, n_tokens, out, size = [], [], [], 0
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(out, pa.binary())], schema=ENCODED)
                del codes, order, lens, flat, starts, place, out, dealt
                tidy()

    whole = blocks.select("block", "doc_ids", "counts", "codes", "order").join(by_block, "block", "left")
    out = whole.select("doc_ids", "counts", "codes", "order", "map").mapInArrow(assemble, "doc_id long, n_tokens long, ids binary")
    out.settled_path = path
    return out


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The input's doc_id, n_tokens and ids, and decoded binary: the bytes of the ids' tokens."""

    def look_up(batches):
        flat, starts = token_bytes(ranks_path)
        for batch in slices(batches):
            found = [gather(flat, starts, np.frombuffer(x or b"", np.uint32).astype(np.int64)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*ENCODED.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(look_up, "doc_id long, n_tokens long, ids binary, decoded binary")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    encoded = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    both = decode(encoded, path)
    out = settle(both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), "bpe-digests")
    discard(encoded)
    return out
