"""Steps over all texts of a slice at once, against the same step text by text."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common, shingles, substrings


def odd_texts(r, n: int) -> list[str]:
    fixed = ["", " ", "\n\n", "a", "A b\tC\x0bd\x0c e\r\nf", "é Ü ÄB ß\xa0nbsp words", "word " * 40, "one two three four five six\n" * 3]
    return fixed + ["".join(r.choice("aB é\t\n\r\x0b\x0cßZ ") for _ in range(r.randrange(120))) for _ in range(n)] + [" ".join(r.choice(["the", "Of", "x"]) for _ in range(r.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_words_of_many_texts_at_once(n):
    """The arrays over all texts of a slice are those that each text has alone, slices of arrays too."""
    texts, hashes = odd_texts(random.Random(3), 150), shingles.WordHashes()
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        words = shingles.words_of(pa.array(["no ne", *texts], kind).slice(1))
        own = [t.encode().lower().split() for t in texts]
        assert words.hashes.tolist() == [hashes[w] for x in own for w in x] and words.ends.tolist() == np.cumsum([len(x) for x in own]).tolist()
        assert [words.data[x:y].tobytes() for x, y in zip(words.starts, words.stops)] == [w for x in own for w in x]
        flat, sizes = shingles.shingle_lists(words, n)
        lists = [shingles.shingle_list(t.encode(), n, hashes) for t in texts]
        assert sizes.tolist() == [len(x) for x in lists] and flat.tolist() == np.concatenate(lists).tolist()
    assert len(shingles.words_of(pa.array([], pa.string())).hashes) == 0


@pytest.mark.parametrize("n,whole", [(2, False), (5, False), (5, True)])
def test_pairs_are_compared_together(n, whole):
    """The same verdicts as pair by pair, in a number of calls that doesn't grow with the pairs: that cost op6 its budget of CPU."""
    r, hashes = random.Random(4), shingles.WordHashes()
    lines = odd_texts(r, 60) + [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(60))) for _ in range(400)]
    pairs = []
    for k, x in enumerate(lines * 2):
        y = x.split()
        for _ in range(r.randrange(4)):
            y[r.randrange(len(y) + 1) :] = r.choice([["other"], y[:9], []])
        pairs.append((x, k // 2, " ".join(y) if k % 2 == 0 else pairs[-1][2]))
    xs, b, ys = (list(c) for c in zip(*pairs))

    def alike(x, y):
        lists = [shingles.shingle_list(t.encode(), n, hashes) for t in (x, y)]
        p, q = (set(i.tolist()) for i in lists)
        return 100 * len(p & q) >= 80 * len(p | q) and (not whole or shingles.mostly_in(*lists, 80))

    def calls(k):
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
        try:
            got = shingles.similar_pairs(pa.array(xs[:k]), pa.array(ys[:k]), np.array(b[:k]), n, 80, whole)
        finally:
            sys.setprofile(None)
        return got.tolist(), len(seen)

    want = [alike(x, y) for x, y in zip(xs, ys)]
    got, many = calls(len(xs))
    assert got == want and 50 < sum(want) < len(want) - 50
    # texts of fewer than n words are hashed one by one
    short = sum(len(t.split()) < n for t in xs + ys)
    assert many - 20 * short < 2 * len(xs)


def test_chains_of_many_rows_at_once():
    r, rows = random.Random(6), []
    for i in range(400):
        hits, at, where = [], 0, (None, 5, 3)
        for k in range(r.randrange(1, 20)):
            at += r.randrange(1, 19)
            where = (r.choice([None, 0, 1]), r.choice([5, 6]), r.randrange(40)) if r.random() < 0.2 else where
            if r.random() < 0.9:
                hits.append({"k": k, "at": at, "source": where[0], "there_rid": where[1], "there": at + where[2]})
        r.shuffle(hits)
        rows.append(hits)
    want = []
    for i, hits in enumerate(rows):
        last = None
        for h in sorted(hits, key=lambda h: h["k"]):
            where = (h["source"], h["there_rid"], h["at"] - h["there"])
            if last and last["k"] + 1 == h["k"] and (last["source"], last["there_rid"], last["at"] - last["there"]) == where and h["at"] - last["at"] <= substrings.WINDOW:
                want[-1][4], want[-1][6] = h["at"], h["there"]
            else:
                want.append([i, *where[:2], h["at"], h["at"], h["there"], h["there"]])
            last = h
    kind = pa.list_(pa.struct([("k", pa.int32()), ("at", pa.int32()), ("source", pa.int64()), ("there_rid", pa.int64()), ("there", pa.int32())]))
    row, columns = substrings.chains(pa.array([[], *rows], kind).slice(1))
    assert [list(x) for x in zip(row.tolist(), *[c.to_pylist() for c in columns])] == want and len({w[0] for w in want}) < len(want)
    assert not len(substrings.chains(pa.array([], kind))[0])


def test_slices_by_bytes_of_text():
    batch = pa.record_batch([pa.array(range(6)), pa.array(["aaaa", None, "bb", "c" * 50, "d", "e"])], ["id", "text"])
    cut = lambda **k: [b.column(0).to_pylist() for b in common.text_slices(iter([batch, batch.slice(0, 0)]), 1, **k)]
    assert cut(most=6) == [[0, 1, 2], [3], [4, 5]] and cut(most=10**6) == [[0, 1, 2, 3, 4, 5]] and cut(most=10**6, rows=4) == [[0, 1, 2, 3], [4, 5]]
