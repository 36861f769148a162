"""Sets of hashed word shingles."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache


class WordHashes(dict):
    """Hashes of words, kept up to a bound."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes() -> WordHashes:
    cache = worker_cache()
    if "word hashes" not in cache:
        cache["word hashes"] = WordHashes()
    return cache["word hashes"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, of which there are as many or more."""
    with np.errstate(over="ignore"):
        h = words[: len(words) - n + 1] + np.uint64(n)
        for i in range(1, n):
            h = mixed(h) * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
    return mixed(h)


def shingle_list(text: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    """Hashes of the n-word shingles of a text (UTF-8) in their order, A-Z lower-cased, words split at ASCII white space."""
    words = np.array(list(map(hashes.__getitem__, text.lower().split())), np.uint64)
    return chained(words, min(n, len(words))) if len(words) else words


def shingle_set(text: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text."""
    return np.unique(shingle_list(text, n, hashes))


def mostly_in(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether so many per cent of the places of either list hold what the other has: sets of texts that repeat themselves say little of their words."""
    return all(100 * np.isin(a, b).sum() >= percent * len(a) for a, b in ((x, y), (y, x)))


LOWERED, BLANK = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
LOWERED[65:91] += 32
BLANK[[9, 10, 11, 12, 13, 32]] = True


class Words(NamedTuple):
    """Words of texts laid end to end: their hashes and where each text ends among them; in data, the texts' bytes with A-Z lower-cased, where each word begins and ends and where each text ends."""

    hashes: np.ndarray
    ends: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    data: np.ndarray
    edges: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """The words of texts without nulls, as shingle_list splits and hashes them; every distinct word is hashed once."""
    import xxhash

    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = LOWERED[np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]]
    edges = offsets[1:] - offsets[0]
    blank = BLANK[data]
    # a word begins or ends where a blank does, and at the edges of its text
    apart = np.ones(len(data) + 1, bool)
    apart[1:-1] = blank[1:] | blank[:-1]
    apart[edges] = True
    starts, stops = np.flatnonzero(apart[:-1] & ~blank), np.flatnonzero(apart[1:] & ~blank) + 1
    solid, bounds = data[~blank], np.concatenate([[0], np.cumsum(stops - starts)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(solid)]).dictionary_encode()
    distinct = pc.binary_join(pa.LargeListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(b" ", pa.large_binary()))
    known = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, distinct[0].as_py().split())), ">u8").astype(np.uint64)
    return Words(known[np.asarray(coded.indices)], np.searchsorted(starts, edges), starts, stops, data, edges)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def shingle_lists(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle lists of texts end to end, and how long each is."""
    first = np.concatenate([[0], words.ends[:-1]]).astype(np.int64)
    many = words.ends - first
    sizes = np.where(many >= n, many - n + 1, np.minimum(many, 1))
    flat = chained(np.concatenate([words.hashes, np.zeros(n - 1, np.uint64)]), n)[ranges(first, sizes)]
    ends = np.cumsum(sizes)
    for t in np.flatnonzero((many > 0) & (many < n)):
        flat[ends[t] - 1] = chained(words.hashes[first[t] : words.ends[t]], int(many[t]))[0]
    return flat, sizes


def similar_pairs(texts_a: pa.Array, texts_b: pa.Array, b: np.ndarray, n: int, percent: int, whole: bool) -> np.ndarray:
    """Which pairs of texts have shingle sets of the similarity, and with whole so many of their places too (mostly_in), at once; b tells texts_b apart, of which neighbours may be the same."""
    new = np.concatenate([[True], b[1:] != b[:-1]])
    flat_a, sizes_a = shingle_lists(words_of(texts_a), n)
    flat_b, sizes_b = shingle_lists(words_of(texts_b.filter(pa.array(new))), n)
    at = np.cumsum(new) - 1
    flat_b, sizes_b = flat_b[ranges((np.cumsum(sizes_b) - sizes_b)[at], sizes_b[at])], sizes_b[at]
    pairs = len(b)
    shingle, pair = np.concatenate([flat_a, flat_b]), np.concatenate([np.repeat(np.arange(pairs), x) for x in (sizes_a, sizes_b)])
    if not len(shingle):
        return np.ones(pairs, bool)
    order = np.argsort(shingle)
    order = order[np.argsort(pair[order].astype(np.min_scalar_type(pairs)), kind="stable")]
    shingle, pair = shingle[order], pair[order]
    group = np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (pair[1:] != pair[:-1])]))
    in_a = np.add.reduceat((order < len(flat_a)).astype(np.int64), group)
    in_b = np.diff(group, append=len(order)) - in_a
    both, pair = (in_a > 0) & (in_b > 0), pair[group]
    total = lambda x: np.bincount(pair, x, pairs)
    shared = total(both)
    keep = 100 * shared >= percent * (total(in_a > 0) + total(in_b > 0) - shared)
    if whole:
        keep &= (100 * total(in_a * both) >= percent * sizes_a) & (100 * total(in_b * both) >= percent * sizes_b)
    return keep
