"""Repeated passages: paragraph MinHash banding, and anchors for verbatim passages that no paragraph bounds.

Paragraphs find passages that were edited. A paragraph is a line of ``min_words`` words or more, as the set of its
five-word shingles. 24 min-hashes make ``BANDS`` bands of two, tuned for recall: paragraphs of similarity 0.8 share none
of them with odds 5e-6 (1 - 0.8^2, twelve times over).

1. Equal paragraphs are one node, by a 128-bit fingerprint of their words.
2. Nodes that share a band key are linked as in near-duplicate search: stars first, then pairs across components, each
   confirmed by exact Jaccard similarity of the full sets, 0.8 or more; of their places as many must agree too, since
   filler that repeats itself counts little in a set. Of 64 further min-hashes, a byte each, 33 must
   agree before a pair is compared (at 0.8: all but 8e-8), so that phrases common to unlike paragraphs stay cheap. Under a
   key of many nodes, such as variants of one line, pairs are made by the shingles that are rarest among those nodes and by
   their places in that order: sets of similarity 0.8 share one of the first fifth, early enough. That rule loses no pair.
3. Components are clusters of repeated paragraphs. The first occurrence (least doc_id, then position) stays;
   occurrences in other documents are marked.

Anchors find passages wherever they start: of every ``WINDOW`` 16-word runs in a row the one of least hash is an anchor
(winnowing), whatever stands around. Two texts that share 31 words in a row or more share an anchor in every 31 of them.
Neighbouring anchors of a text that stand in the same earlier document at the same distance make a chain; its ends are
held against that document word by word and extended as far as the words agree: where its copy was edited, up to
``WINDOW`` - 1 words that a later copy has may stay. What a chain covers is marked.

A run of marks, with fewer than ``min_words`` words between, goes if it has ``min_run`` words or more: by default 31, the
length from which every verbatim passage is found. Shorter repeats, such as licence lines, stay. A few words over and over
(``PERIOD``, ``LEAST_SHINGLES``) are no passage: junk of the same word in two documents isn't copied from one to the other.

Words around the ends of chains and paragraphs to compare are fetched in one pass over the texts, of which only those are
moved that are asked for while their keys are few enough to be broadcast (checked), beyond that all, once. Band keys and
anchors are first counted alone, and only rows of shared ones go further.

Edge cases: null and empty texts have no paragraphs and stay as they are; what is repeated only
inside one document stays; rows with equal id and text are handled alike; null ids count as one document;
documents left without a word are dropped by drop_repeated; an empty table gives an empty result; extra
columns ride along.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcastable, discard, discard_all, few_tasks, free_shuffles, row_key, settle, slices, table, text_slices, tidied
from .components import crowded_pairs, link_collisions
from .neardup import FP, confirmed, equal_bytes, met_nodes, numbered, shared_keys, with_least
from .shingles import BLANK, chained, mixed, ranges, words_of

SHINGLE = 5
BANDS, ROWS = 12, 2
#: Words of an anchor, and of how many in a row one is chosen (a power of two). Passages of ANCHOR + WINDOW - 1 words hold one.
ANCHOR, WINDOW = 16, 16
#: Texts that repeat after so many words or fewer hold no anchor, and lines of fewer than LEAST_SHINGLES distinct shingles are no paragraph.
PERIOD, LEAST_SHINGLES = 6, 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FACTORS, SHIFTS = odd_numbers(BANDS * ROWS, 31), odd_numbers(BANDS * ROWS, 32)


def anchor_positions(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts laid end to end: their words' five-word shingle hashes, and where each text ends."""
    n = len(h) + SHINGLE - ANCHOR
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        whole = h[:n].copy()
        for at in (5, 10, 11):
            whole = mixed(whole) * np.uint64(0x9E3779B97F4A7C15) + h[at : n + at]
        whole = mixed(whole)
    least = whole
    for step in (1 << i for i in range(WINDOW.bit_length() - 1)):
        least = np.minimum(least[:-step], least[step:])
    # windows that reach into the next text choose nothing
    text = np.searchsorted(ends, np.arange(len(least)), side="right")
    least = np.where(np.arange(len(least)) + ANCHOR + WINDOW - 1 <= ends[text], least, np.uint64(0))
    best = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    for step in (1 << i for i in range(WINDOW.bit_length() - 1)):
        best = np.maximum(best[:-step], best[step:])
    chosen = np.flatnonzero(best == whole)
    # a few words over and over are no passage
    steady = np.any([h[chosen] == h[chosen + k] for k in range(1, PERIOD + 1)], axis=0)
    chosen = chosen[~steady]
    return chosen, whole[chosen]


def band_keys(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of sets of shingle hashes laid end to end, which begin at starts; repeats don't matter."""
    out = np.empty((len(starts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(starts), band + 1, np.uint64)
            for k in range(ROWS * band, ROWS * (band + 1)):
                key = mixed(key) + np.minimum.reduceat((own ^ SHIFTS[k]) * FACTORS[k], starts)
            out[:, band] = mixed(key)
    return out


#: Columns of a signature; eight bytes each.
SIGNS = tuple(f"s{i}" for i in range(8))
SALTS = np.array([0x632BE59BD9B4E019 * (101 + k) % 2**64 for k in range(8 * len(SIGNS))], np.uint64)


def signatures(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, SIGNS) bytes of 64 min-hashes, eight to an integer, of sets of shingle hashes laid end to end, which begin at starts; repeats don't matter."""
    out = np.empty((len(starts), len(SALTS)), np.uint8)
    with np.errstate(over="ignore"):
        for k, salt in enumerate(SALTS):
            out[:, k] = np.minimum.reduceat(mixed(own + salt), starts) & np.uint64(255)
    return out.view(np.int64)


def alike(percent: int):
    """As many bytes of both signatures agree as at the threshold, less 5.5 deviations (all but 8e-8 of pairs at 0.8)."""
    p, n = percent / 100, 8 * len(SIGNS)
    same = sum((equal_bytes(F.col(f"{s}_a"), F.col(f"{s}_b")) for s in SIGNS), F.lit(0))
    return same >= int(n * (p - 5.5 * (p * (1 - p) / n) ** 0.5))


def lists(flat: pa.Array, counts) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)


CUT = "doc_id long, rid long, at array<int>, until array<int>, fp1 array<long>, fp2 array<long>, keys array<array<long>>, anchor_at array<int>, anchor array<long>"


def pieces_of(texts: DataFrame, min_words: int) -> DataFrame:
    """One row a text: its paragraphs' words, fingerprints and band keys, and its anchors."""

    def cut(batches):
        import xxhash

        for batch in text_slices(batches, 2):
            words = words_of(batch.column(2))
            w, text_ends = words.hashes, words.ends
            text_starts = np.concatenate([[0], text_ends[:-1]])
            line_ends = np.searchsorted(words.starts, np.union1d(np.flatnonzero(words.data == 10), words.edges))
            edge = np.stack([np.concatenate([[0], line_ends[:-1]]), line_ends], 1)
            edge = edge[edge[:, 1] - edge[:, 0] >= min_words]
            of = np.searchsorted(text_ends, edge[:, 0], side="right")
            counts = np.bincount(of, minlength=batch.num_rows)
            h = chained(w, SHINGLE) if len(w) >= SHINGLE else np.zeros(0, np.uint64)
            if len(edge):  # shingles that are not among the three before them
                new = np.ones(len(h), np.int64)
                for k in range(1, LEAST_SHINGLES):
                    new[k:] &= h[k:] != h[:-k]
                several = np.concatenate([[0], np.cumsum(new)])
                varied = several[edge[:, 1] - SHINGLE + 1] - several[edge[:, 0]] >= LEAST_SHINGLES
                edge, of = edge[varied], of[varied]
                counts = np.bincount(of, minlength=len(counts))
            fps = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w[x:y].tobytes()) for x, y in edge.tolist()), np.int64).reshape(-1, 2)
            keys = np.zeros((0, BANDS), np.uint64)
            if len(edge):
                sizes = edge[:, 1] - edge[:, 0] - SHINGLE + 1
                keys = band_keys(h[ranges(edge[:, 0], sizes)], np.cumsum(sizes) - sizes)
            at, anchors = anchor_positions(h, text_ends)
            anchor_of = np.searchsorted(text_ends, at, side="right")
            n_anchors = np.bincount(anchor_of, minlength=len(counts))
            columns = [(edge[:, k] - text_starts[of]).astype(np.int32) for k in range(2)] + [np.ascontiguousarray(fps[:, k]) for k in range(2)]
            nested = lists(pa.array(np.ascontiguousarray(keys).ravel().view(np.int64)), np.full(len(keys), BANDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[lists(pa.array(c), counts) for c in columns], lists(nested, counts), lists(pa.array((at - text_starts[anchor_of]).astype(np.int32)), n_anchors), lists(pa.array(anchors.view(np.int64)), n_anchors)],
                ["doc_id", "rid", "at", "until", "fp1", "fp2", "keys", "anchor_at", "anchor"],
            )

    return texts.select("doc_id", "rid", "text").mapInArrow(tidied(cut), CUT)


def rows_of(cut: DataFrame, keep: list[str], *columns: str) -> DataFrame:
    """One row an element of the parallel arrays columns, with the columns keep."""
    zipped = cut.select(*keep, F.explode(F.arrays_zip(*columns)).alias("z"))
    return zipped.select(*keep, *[f"z.{c}" for c in columns])


def asked_texts(texts: DataFrame, asked: DataFrame, run: str) -> DataFrame:
    """asked (doc_id, rid and others; settled; ids may be null) with the text of each row; rows of equal id and text come as often as they are there.

    The texts that are asked for are picked by their keys where they are read; only those are moved.
    """
    keys = settle(asked.select(F.col("doc_id").alias("asked_id"), F.col("rid").alias("asked_rid")), f"{run}-keys")
    own = (F.col("rid") == F.col("asked_rid")) & F.col("doc_id").eqNullSafe(F.col("asked_id"))
    some = texts.join(broadcastable(keys), own, "left_semi")
    return some.join(asked.withColumnsRenamed({"doc_id": "asked_id", "rid": "asked_rid"}), own).drop("asked_id", "asked_rid")


def met_paragraphs(cut: DataFrame, run: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """met (key, fp1), places (id and p, the first place of each node) and ids (id, fp1, fp2) of paragraphs that share a band with others, and what later steps need of cut, which is deleted."""
    shared = shared_keys(cut.select(F.explode(F.flatten("keys")).alias("key")), run)
    keyed = rows_of(cut, [], "fp1", "keys").select("fp1", F.explode("keys").alias("key"))
    met, nodes = met_nodes(keyed, shared, run)
    lines = settle(cut.drop("keys", "anchor_at", "anchor"), f"{run}-lines")
    discard(cut)
    place = F.min(F.struct("doc_id", "at", "until", "rid")).alias("p")
    places = numbered(rows_of(lines, ["doc_id", "rid"], "at", "until", "fp1", "fp2").join(broadcastable(nodes), "fp1").groupBy(*FP).agg(place), f"{run}-places")
    return met, places, settle(places.select("id", *FP), f"{run}-ids"), lines


def linked_paragraphs(met: DataFrame, quoted: DataFrame, ids: DataFrame, percent: int, run: str) -> DataFrame:
    """fp1, fp2, c1, c2: paragraphs that are similar to others but not equal, and the fingerprint that stands for their component."""
    rows = met.count()
    told = settle(few_tasks(quoted.select("id", "n", *SIGNS), rows), f"{run}-signs")
    signed = with_least(met.join(broadcastable(ids), "fp1").select("key", "id"), told, rows, run)
    discard(met, told)
    written, texts = quoted.select("id", "text", *SIGNS), quoted.select("id", "text")

    def confirm(pairs: DataFrame, at: str) -> DataFrame:
        return confirmed(pairs, written, SHINGLE, percent, f"{run}-{at}", alike(percent), whole=True)

    final = link_collisions(signed, percent, confirm, run, texts, SHINGLE, SIGNS, alike(percent), lambda many, name: crowded_pairs(many, texts, percent, SHINGLE, name), whole=True)
    named = ids.select(F.col("id").alias("component"), F.col("fp1").alias("c1"), F.col("fp2").alias("c2"))
    return settle(few_tasks(final.join(ids, "id").join(named, "component"), rows).select(*FP, "c1", "c2"), f"{run}-linked")


def in_several() -> list:
    """Aggregates over doc_id: the least, and whether there are several (null ids are one document)."""
    nulls = F.max(F.col("doc_id").isNull())
    return [F.when(~nulls, F.min("doc_id")).alias("source"), ((nulls & F.max("doc_id").isNotNull()) | (~nulls & (F.min("doc_id") < F.max("doc_id")))).alias("several")]


def repeated_paragraphs(cut: DataFrame, linked: DataFrame, run: str) -> DataFrame:
    """doc_id, rid, marks: the paragraphs of each row whose cluster begins in another document."""
    lines = rows_of(cut, ["doc_id", "rid"], "at", "until", "fp1", "fp2").join(broadcastable(linked), FP, "left")
    lines = lines.select("doc_id", "rid", "at", "until", F.coalesce("c1", "fp1").alias("c1"), F.coalesce("c2", "fp2").alias("c2"))
    clusters = settle(lines.groupBy("c1", "c2").agg(*in_several()).where("several").drop("several"), f"{run}-clusters")
    marked = lines.join(broadcastable(clusters), ["c1", "c2"]).where(~F.col("doc_id").eqNullSafe(F.col("source")))
    return marked.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("at", "until", "source")).alias("marks"))


def chains(hits: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Of rows of hits (k, at, source, there_rid, there): the row of each chain, and its source, the source's row, first and last place here, first and last place there. A chain is neighbouring anchors at equal distances.

    Anchors of a verbatim stretch are WINDOW words apart at most, so that they cover it; where they are further apart (those of periodic text were dropped) another chain begins.
    """
    row = np.repeat(np.arange(len(hits)), np.asarray(hits.value_lengths().fill_null(0)))
    k, at, source, there_rid, there = hits.flatten().flatten()
    order = np.lexsort((np.asarray(k), row))
    row, source, there_rid = row[order], source.take(pa.array(order)), np.asarray(there_rid)[order]
    k, at, there = (np.asarray(x).astype(np.int64)[order] for x in (k, at, there))
    told = (row, k - np.arange(len(k)), np.asarray(source.is_null()), np.asarray(source.fill_null(0)), there_rid, at - there)
    on = np.all([x[1:] == x[:-1] for x in told], axis=0) & (at[1:] - at[:-1] <= WINDOW)
    first, last = np.flatnonzero(np.concatenate([[True], ~on])[: len(k)]), np.flatnonzero(np.concatenate([~on, [True]])[: len(k)])
    return row[first], [source.take(pa.array(first)), pa.array(there_rid[first]), *[pa.array(x[p].astype(np.int32)) for x in (at, there) for p in (first, last)]]


CHAIN = "source long, there_rid long, first int, last int, there_first int, there_last int"
CHAIN_COLUMNS = tuple(x.split()[0] for x in CHAIN.split(", "))


def anchored_chains(cut: DataFrame, run: str) -> DataFrame:
    """doc_id, rid and CHAIN of anchors that stand in an earlier document too."""
    anchors = cut.select("doc_id", "rid", F.posexplode(F.arrays_zip("anchor_at", "anchor")).alias("k", "z")).select("doc_id", "rid", "k", F.col("z.anchor_at").alias("at"), F.col("z.anchor").alias("fp"))
    shared = settle(anchors.select("fp", "doc_id").groupBy("fp").agg(*in_several()).where("several").drop("several"), f"{run}-shared")
    free_shuffles(cut.sparkSession)
    # both sides grow with the texts: a shuffle at every size
    hits = settle(anchors.join(shared.hint("merge"), "fp"), f"{run}-hits", "zstd")
    discard(shared)
    free_shuffles(cut.sparkSession)
    first = hits.where(F.col("doc_id").eqNullSafe(F.col("source"))).groupBy("fp").agg(F.min(F.struct("rid", "at")).alias("p"))
    first = settle(first.select("fp", F.col("p.rid").alias("there_rid"), F.col("p.at").alias("there")), f"{run}-first")
    copies = hits.where(~F.col("doc_id").eqNullSafe(F.col("source"))).join(first.hint("merge"), "fp")
    by_row = copies.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("k", "at", "source", "there_rid", "there")).alias("hits"))

    def link(batches):
        for batch in slices(batches):
            row, columns = chains(batch.column(2))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in range(2)], *columns], ["doc_id", "rid", *CHAIN_COLUMNS])

    out = settle(by_row.mapInArrow(link, f"doc_id long, rid long, {CHAIN}"), f"{run}-chains")
    discard(hits, first)
    return out


def runs_of(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values from each start up to its stop, as their bytes."""
    sizes = stops - starts
    ends = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    if ends[-1] >= 1 << 31:
        raise OverflowError("runs of 2 GB")
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values[ranges(starts, sizes)])])


def fetched(texts: DataFrame, found: DataFrame, places: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Of one pass over the texts: contexts (doc_id, rid, place, left, right: codes of the words around it) of the ends of chains and of what they are chained to, and quoted (id, text, n, SIGNS) paragraphs."""
    ends = [found.select(F.col(d).alias("doc_id"), F.col(r).alias("rid"), F.explode(F.array(*pair)).alias("place")) for d, r, pair in (("doc_id", "rid", ("first", "last")), ("source", "there_rid", ("there_first", "there_last")))]
    none = F.lit(None).cast("struct<id:bigint,at:int,until:int>")
    asked = ends[0].unionAll(ends[1]).select("*", none.alias("span"))
    asked = asked.unionAll(places.select("p.doc_id", "p.rid", F.lit(None).cast("int").alias("place"), F.struct("id", "p.at", "p.until").alias("span")))
    asked = settle(asked.groupBy("doc_id", "rid").agg(F.collect_set("place").alias("places"), F.collect_list("span").alias("spans")), f"{run}-asked")

    def fetch(batches):
        for batch in text_slices(batches, 4):
            words = words_of(batch.column(4))
            text_starts = np.concatenate([[0], words.ends[:-1]])
            # four bytes a word: two words are taken for one with odds of 2e-10
            codes = words.hashes.astype(np.uint32)
            row, of = (np.repeat(np.arange(batch.num_rows), np.asarray(batch.column(c).value_lengths().fill_null(0))) for c in (2, 3))
            at = np.asarray(batch.column(2).flatten()).astype(np.int64)
            x, start, end = text_starts[row] + at, text_starts[row], words.ends[row]
            left = runs_of(codes, np.maximum(start, x - WINDOW + 1), np.minimum(end, x + ANCHOR), pa.binary())
            right = runs_of(codes, x, np.minimum(end, x + ANCHOR + WINDOW - 1), pa.binary())
            ids, *edge = batch.column(3).flatten().flatten()
            edge = [np.asarray(e).astype(np.int64) + text_starts[of] for e in edge]
            # one blank between words, whatever stands there
            kept = ~BLANK[words.data]
            kept[1:] |= kept[:-1]
            spaced, place = np.where(BLANK, 32, np.arange(256)).astype(np.uint8)[words.data[kept]], np.cumsum(kept)
            quotes = runs_of(spaced, place[words.starts[edge[0]]] - 1, place[words.stops[edge[1] - 1] - 1], pa.string())
            sizes = edge[1] - edge[0] - SHINGLE + 1
            own, owner = chained(words.hashes, SHINGLE)[ranges(edge[0], sizes)] if len(ids) else np.zeros(0, np.uint64), np.repeat(np.arange(len(ids)), sizes)
            signs = signatures(own, np.cumsum(sizes) - sizes) if len(ids) else np.zeros((0, len(SIGNS)), np.int64)
            order = np.lexsort((own, owner))
            own, owner = own[order], owner[order]
            n = np.bincount(owner[np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])])[: len(own)])], minlength=len(ids))
            row, a, b = pa.array(row, pa.int32()), len(row), len(ids)
            blank = lambda n, t: pa.nulls(n, t)
            both = lambda x, y: pa.concat_arrays([x, y])
            yield pa.RecordBatch.from_arrays(
                [
                    *[both(batch.column(c).take(row), blank(b, pa.int64())) for c in range(2)], both(pa.array(at.astype(np.int32)), blank(b, pa.int32())), *[both(x, blank(b, pa.binary())) for x in (left, right)],
                    both(blank(a, pa.int64()), ids), both(blank(a, pa.string()), quotes), both(blank(a, pa.int32()), pa.array(n.astype(np.int32))),
                    *[both(blank(a, pa.int64()), pa.array(np.ascontiguousarray(signs[:, i]))) for i in range(len(SIGNS))],
                ],
                ["doc_id", "rid", "place", "left", "right", "id", "text", "n", *SIGNS],
            )

    out = asked_texts(texts, asked, run).select("doc_id", "rid", "places", "spans", "text").mapInArrow(tidied(fetch), "doc_id long, rid long, place int, left binary, right binary, id long, text string, n int, " + ", ".join(f"{x} long" for x in SIGNS))
    out = settle(out, f"{run}-fetched", "zstd")
    # rows of equal id and text have told the same
    contexts = out.where("place IS NOT NULL").select("doc_id", "rid", "place", "left", "right").dropDuplicates(["doc_id", "rid", "place"])
    quoted = settle(out.where("id IS NOT NULL").select("id", "text", "n", *SIGNS).dropDuplicates(["id"]), f"{run}-quoted", "zstd")
    contexts = settle(contexts, f"{run}-contexts")
    discard(asked, out)
    return contexts, quoted


def same_words(x: np.ndarray, y: np.ndarray) -> int:
    """How many words at the start of both are the same."""
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    return int(other[0]) if len(other) else n


def reach(own: bytes, theirs: bytes, before: int | None = None, before_there: int = 0) -> int:
    """How many words agree from an anchor on (before is None), or in front of it; -1 if the anchors themselves don't. Codes begin at the anchor, or so many words before it."""
    x, y = np.frombuffer(own, np.uint32), np.frombuffer(theirs, np.uint32)
    ahead = same_words(x[before or 0 :], y[before_there:])
    if ahead < ANCHOR:
        return -1
    return ahead if before is None else same_words(x[:before][::-1], y[:before_there][::-1])


def verbatim_marks(found: DataFrame, contexts: DataFrame, run: str) -> DataFrame:
    """id, rid, extended: marks (first word, end word, source) of the chains whose ends are confirmed, as far as the words agree with the source's."""
    for name, side, own, there in (("back", "left", "first", "there_first"), ("ahead", "right", "last", "there_last")):
        for role, keys in (("own", ("doc_id", "rid", own)), ("theirs", ("source", "there_rid", there))):
            near = contexts.select(F.col("doc_id").alias("q_id"), F.col("rid").alias("q_rid"), F.col("place").alias("q_at"), F.col(side).alias(role))
            found = found.join(near, (F.col(keys[1]) == F.col("q_rid")) & (F.col(keys[2]) == F.col("q_at")) & F.col(keys[0]).eqNullSafe(F.col("q_id"))).drop("q_id", "q_rid", "q_at")
        columns = [c for c in found.columns if c not in ("own", "theirs")]

        def measure(batches, name=name, at=columns.index(own), there=columns.index(there), n=len(columns)):
            for batch in slices(batches, 4096):
                x, y, a, b = (batch.column(c).to_pylist() for c in (n, n + 1, at, there))
                got = [reach(p, q) if name == "ahead" else reach(p, q, min(i, WINDOW - 1), min(j, WINDOW - 1)) for p, q, i, j in zip(x, y, a, b)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got, pa.int32())], [*batch.schema.names[:n], name])

        found = found.select(*columns, "own", "theirs")
        schema = ", ".join(f"{c} {t}" for c, t in found.dtypes if c in columns) + f", {name} int"
        found = settle(found.mapInArrow(measure, schema).where(F.col(name) >= 0), f"{run}-{name}")
    mark = F.struct((F.col("first") - F.col("back")).alias("at"), (F.col("last") + F.col("ahead")).alias("until"), "source")
    return found.groupBy(F.col("doc_id").alias("id"), "rid").agg(F.collect_set(mark).alias("extended"))


def merged_runs(marks: list[tuple], min_words: int, min_run: int) -> tuple[list[tuple[int, int]], set]:
    """Runs (first word, end word) of min_run words or more of marks (at, until, source), and their sources."""
    runs, sources = [], set()
    marks = sorted(marks, key=lambda m: m[:2])
    at = 0
    while at < len(marks):
        end, until = at, marks[at][1]
        while end + 1 < len(marks) and marks[end + 1][0] - until < min_words:
            end += 1
            until = max(until, marks[end][1])
        if until - marks[at][0] >= min_run:
            runs.append((marks[at][0], until))
            sources.update(m[2] for m in marks[at : end + 1] if m[2] is not None)
        at = end + 1
    return runs, sources


def removed_runs(paragraphs: list[tuple], anchored: list[tuple], min_words: int, min_run: int, min_paragraph: int) -> tuple[list[tuple[int, int]], set]:
    """Runs of marks of both kinds, and paragraphs of min_paragraph words or more whatever stands around them."""
    runs, sources = merged_runs([*paragraphs, *anchored], min_words, min_run)
    if min_paragraph < min_run:
        alone = [m for m in paragraphs if m[1] - m[0] >= min_paragraph]
        runs, _ = merged_runs([*[(x, y, None) for x, y in runs], *alone], 1, 1)
        sources |= {m[2] for m in alone if m[2] is not None}
    return runs, sources


def repeated_spans(docs: DataFrame, percent: int = 80, min_words: int = 8, min_run: int = ANCHOR + WINDOW - 1, min_paragraph: int = ANCHOR + WINDOW - 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """min_run words in a row are a passage; a paragraph that repeats goes from min_paragraph words on (min_words takes all that are compared, licence lines too).

    Returns doc_id, rid (hash of id and text), spans: array of (at, until), words to remove counted from 0, words removed, sources: doc_ids that keep the passages."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("text").isNotNull()).select("doc_id", row_key().alias("rid"), "text")
    run = f"paragraphs_{uuid.uuid4().hex}"
    cut = settle(pieces_of(texts, max(min_words, SHINGLE)), f"{run}-pieces", "zstd")
    found = anchored_chains(cut, run)
    free_shuffles(docs.sparkSession)
    met, places, ids, lines = met_paragraphs(cut, run)
    contexts, quoted = fetched(texts, found, places, run)
    free_shuffles(docs.sparkSession)
    anchored = settle(verbatim_marks(found, contexts, run), f"{run}-extended")
    discard(contexts, found)
    free_shuffles(docs.sparkSession)
    paragraphs = repeated_paragraphs(lines, linked_paragraphs(met, quoted, ids, percent, run), run)

    def runs(batches):
        for batch in slices(batches):
            spans, words, sources = [], [], []
            for marks, more in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both = [[tuple(m[k] for k in ("at", "until", "source")) for m in x or ()] for x in (marks, more)]
                own, told = removed_runs(*both, min_words, min_run, min_paragraph)
                spans.append([{"at": x, "until": y} for x, y in own])
                words.append(sum(y - x for x, y in own))
                sources.append(sorted(told))
            span = pa.list_(pa.struct([("at", pa.int32()), ("until", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, span), pa.array(words, pa.int64()), pa.array(sources, pa.list_(pa.int64()))], ["doc_id", "rid", "spans", "words", "sources"])

    both = paragraphs.join(anchored.withColumnRenamed("rid", "rid_2"), (F.col("rid") == F.col("rid_2")) & F.col("doc_id").eqNullSafe(F.col("id")), "full")
    both = both.select(F.when(F.col("rid").isNull(), F.col("id")).otherwise(F.col("doc_id")).alias("doc_id"), F.coalesce("rid", "rid_2").alias("rid"), "marks", "extended")
    spans = both.mapInArrow(runs, "doc_id long, rid long, spans array<struct<at:int,until:int>>, words long, sources array<bigint>").where(F.size("spans") > 0)
    out = settle(spans, "spans")
    discard_all(docs.sparkSession, run)
    return out


def without_spans(text: str, spans: list[dict]) -> str:
    """text less the words of spans, each with the blanks after it."""
    data = text.encode()
    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for s in spans:
        out.append(data[at : starts[s["at"]]])
        at = starts[s["until"]]
    return (b"".join(out) + data[at:]).decode()


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of docs; repeated passages are cut out of the texts, and documents left without a word go."""
    found = repeated_spans(docs, id_col=id_col, text_col=text_col, **options)
    spans = found.select(F.col("doc_id").alias("s_id"), F.col("rid").alias("s_rid"), "spans")
    spans.settled_path = found.settled_path
    rest = [c for c in docs.columns if c != text_col]
    keyed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("rec"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    met = keyed.withColumn("rid", row_key()).join(broadcastable(spans), (F.col("rid") == F.col("s_rid")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left").select("rec", "text", "spans")

    def cut(batches):
        for batch in slices(batches):
            texts = [t if not s else without_spans(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            keep = [not s or bool(WORD.search(t.encode())) for t, s in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["rec", "text"]).filter(pa.array(keep, pa.bool_()))

    kept = met.mapInArrow(tidied(cut), met.select("rec", "text").schema)
    kind = docs.schema[text_col].dataType
    return kept.select(*[F.col("text").cast(kind).alias(c) if c == text_col else F.col(f"rec.c{rest.index(c)}").alias(c) for c in docs.columns])


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: how many words repeat passages of earlier documents, where, and which documents keep them."""
    docs = table(spark, sf_dir, "documents")
    found = repeated_spans(docs).withColumnsRenamed({"doc_id": "s_id", "rid": "s_rid"})
    base = docs.select("doc_id", row_key().alias("rid"))
    met = base.join(found, (F.col("rid") == F.col("s_rid")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left")
    return met.select("doc_id", F.coalesce("words", F.lit(0)).cast("long").alias("repeated_words"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"), F.coalesce("spans", F.array().cast("array<struct<at:int,until:int>>")).alias("spans"), F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"), F.col("words").isNotNull().alias("repeats"))
