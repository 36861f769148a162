"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (summed up before the shuffle) and a join back, whose hot nodes Spark
splits; every result is written to the shared folder, so a lost executor never replays the loop. Edges that
are stars already, each on its least node, need no further round. Nodes and edges stay in tables; the driver
sees one row of totals a round, and keeps Spark's record of every plan: steps without rows are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcastable, discard, few_tasks, settle, slices
from .shingles import mostly_in, shingle_list, shingle_set, word_hashes

#: From so many nodes on, a component is compared in blocks of BLOCK texts; keys of CROWD nodes or more are left to crowded, where it is given.
BIG, BLOCK, CROWD = 48, 48, 32
#: Of one crowded node in SAMPLE the shingles are counted, and MAX_FREQUENT at most are told apart.
SAMPLE, MAX_FREQUENT = 8, 100_000


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """edges (u, v) with u > v. Large: hang each greater neighbour on the node's least one; small: each smaller one, and the node."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = few_tasks(both.groupBy("x").agg(F.min("y").alias("m")), rows).select("x", F.least("x", "m").alias("m"))
    hung = few_tasks(both.join(least, "x"), rows).where(F.col("y") > (F.col("x") if large else F.col("m"))).select(F.col("y").alias("u"), F.col("m").alias("v"))
    if not large:
        hung = hung.unionAll(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return few_tasks(hung.where("u > v").distinct(), rows)


def _shape(edges: DataFrame) -> tuple:
    """How many edges (u, v) there are, and how many nodes keep them from being stars: those that hang on several, or hang and are hung on."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hung"), F.lit(0).alias("centre")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("hung"), F.lit(1).alias("centre")))
    nodes = ends.groupBy("x").agg(F.sum("hung").alias("hung"), F.max("centre").alias("centre"))
    return tuple(nodes.agg(F.coalesce(F.sum("hung"), F.lit(0)), F.count_if(F.col("hung") + F.col("centre") > 1)).first())


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """id, component (the least id that it reaches) for every id in an edge; self-loops and repeats don't matter."""
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), f"{name}-edges")
    while (shape := _shape(now))[1]:
        # the small star reads its edges twice: in one plan the large star would stand there twice, and the driver keeps what it shows of plans
        large = settle(_star(now, True, shape[0]), f"{name}-large")
        step = settle(_star(large, False, shape[0]), f"{name}-edges")
        discard(now, large)
        now = step
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return few_tasks(ids.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), 2 * shape[0])


def similar_enough(a: str, b: str, percent: int):
    """Sets whose sizes alone rule out the similarity don't pass."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def in_blocks(rows: DataFrame, size: str, texts: DataFrame, side: str) -> DataFrame:
    """rows (big, id, and how many ids big has in all) as packed blocks of about BLOCK texts: big, <side> (block number), <side>_ids, <side>_texts."""
    dealt = rows.withColumn(side, F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / BLOCK)).cast("int")).join(texts, "id")
    return dealt.groupBy("big", side).agg(F.collect_list("id").alias(f"{side}_ids"), F.collect_list("text").alias(f"{side}_texts"))


def links_to_big(asked: DataFrame, found: DataFrame, sizes: DataFrame, texts: DataFrame, percent: int, shingle: int, name: str, whole: bool = False) -> DataFrame:
    """Links (a, b) of asked (id, big) to members of large components: all of a component's members are looked at, block by block.

    Blocks of asked texts meet blocks of members in one row each; a posting list a shingle counts what all
    their pairs share, so no pair becomes a row. One link is told of each text and block.
    """
    counted = asked.groupBy("big").agg(F.count(F.lit(1)).alias("asked"))
    left = in_blocks(asked.join(counted, "big"), "asked", texts, "x")
    members = found.select("id", F.col("component").alias("big")).join(sizes, "big")
    right = settle(in_blocks(members, "size", texts, "y"), f"{name}-members", "zstd")
    sent = settle(left.join(sizes, "big").withColumn("y", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / BLOCK) - 1).cast("int")))), f"{name}-asked", "zstd")

    def compare(batches):
        hashes = word_hashes()
        for batch in batches:
            found_a, found_b = [], []
            for r in range(batch.num_rows):
                xs, x_texts, ys, y_texts = (column[r].as_py() for column in batch.columns)
                own = [shingle_set(t.encode(), shingle, hashes) for t in y_texts]
                sizes = np.array([len(s) for s in own])
                flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                for x, t in zip(xs, x_texts):
                    s = shingle_set(t.encode(), shingle, hashes)
                    lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
                    hits = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
                    shared = np.bincount(owner[hits], minlength=len(own))
                    linked = np.flatnonzero(100 * shared >= percent * (sizes + len(s) - shared))
                    if whole and len(linked):
                        places = shingle_list(t.encode(), shingle, hashes)
                        linked = [k for k in linked if mostly_in(places, shingle_list(y_texts[k].encode(), shingle, hashes), percent)][:1]
                    if len(linked):
                        found_a.append(x)
                        found_b.append(ys[linked[0]])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return settle(sent.join(right, ["big", "y"]).select("x_ids", "x_texts", "y_ids", "y_texts").mapInArrow(compare, "a long, b long"), f"{name}-links")


def crowded_pairs(many: DataFrame, quoted: DataFrame, percent: int, shingle: int, name: str) -> DataFrame:
    """Pairs (a, b) across components of nodes many (id, c) that may have the similarity, by prefixes of their shingles in one order, and places in them.

    Any order loses no pair; shingles that are frequent in a sample of the nodes come last, so that few rows share a prefix.
    """
    sets = many.join(quoted, "id").select("id", "c", "text")

    def cut(batches):
        hashes = word_hashes()
        for batch in slices(batches):
            own = [shingle_set(t.encode(), shingle, hashes) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], ["s"])

    sample = sets.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(cut, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    frequent = sorted((r.s % 2**64, r.m) for r in sample.orderBy(F.desc("m"), "s").limit(MAX_FREQUENT).collect())
    known, times = np.array([s for s, _ in frequent], np.uint64), np.array([m for _, m in frequent], np.int64)

    def prefixes(batches):
        hashes = word_hashes()
        for batch in slices(batches):
            ids, components, sizes, places, firsts = [], [], [], [], [np.zeros(0, np.uint64)]
            for i, c, t in zip(*(x.to_pylist() for x in batch.columns)):
                s = shingle_set(t.encode(), shingle, hashes)
                rank = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.searchsorted(known, s).clip(max=len(known) - 1)
                    rank = np.where(known[at] == s, times[at], 0)
                first = s[np.lexsort((s, rank))][: len(s) - (percent * len(s) + 99) // 100 + 1]
                ids += [i] * len(first)
                components += [c] * len(first)
                sizes += [len(s)] * len(first)
                places += range(len(first))
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(components, pa.int64()), pa.array(sizes, pa.int32()), pa.array(places, pa.int32()), pa.array(np.concatenate(firsts).view(np.int64))], ["id", "c", "n", "at", "s"])

    rows = settle(sets.mapInArrow(prefixes, "id long, c long, n int, at int, s long"), f"{name}-prefixes")
    x, y = (rows.select("s", F.col("id").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in ("c", "n", "at")]) for i in "ab")
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # shingles in common, if this is the first of them
    may = (F.col("a") > F.col("b")) & (F.col("c_a") != F.col("c_b")) & (most * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
    return x.join(y, "s").where(may).select("a", "b").distinct()


def link_collisions(met: DataFrame, percent: int, confirm, name: str, texts: DataFrame, shingle: int, carry: tuple[str, ...] = (), alike=None, crowded=None, whole: bool = False) -> DataFrame:
    """id, component from met (key, id, n, low, n_low): nodes of n members that share a key, and the key's least node.

    First each node is held against the least of its keys: stars, not all pairs. Confirmed links give
    components; keys that still hold several are searched across them. Nodes that met a component of
    BIG nodes or more are held against all of it in blocks; pairs of small components are made one by one.
    confirm(pairs (a, b), name) returns the pairs that are links; b is the side that may recur without bound.
    alike, of the columns carry of both sides (ending in _a and _b), rules out pairs in the search itself.
    crowded(nodes (id, c: component), name), if given, finds the pairs of nodes that share a key of many: all that may be links.
    whole: of both texts so many places as of their sets must agree, as confirm() sees to for the others.
    texts has id and text. met, if it is a settled table, is deleted once it has been read.
    """
    rows = met.count()
    star = met.where((F.col("id") > F.col("low")) & similar_enough("n", "n_low", percent)).select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    star = settle(few_tasks(star, rows), f"{name}-star")
    found = settle(components(confirm(star, "1"), "a", "b", f"{name}-1"), f"{name}-found")
    sizes = settle(few_tasks(found.groupBy(F.col("component").alias("big")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= BIG), rows), f"{name}-sizes")

    placed = few_tasks(met.select("key", "id", "n", *carry).join(found, "id", "left"), rows).withColumn("c", F.coalesce("component", "id"))
    split = few_tasks(placed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")), rows).where("c1 < c2").select("key")
    known = few_tasks(placed.join(split, "key").join(sizes, F.col("c") == F.col("big"), "left"), rows).select("key", "id", "n", *carry, "c", F.coalesce("size", F.lit(0)).alias("size"))
    known = settle(known, f"{name}-known")
    discard(met)

    big = few_tasks(known.where("size > 0").select("key", F.col("c").alias("big"), F.col("size").alias("big_size")).distinct(), rows)
    asked = known.join(big, "key").where((F.col("c") != F.col("big")) & ((F.col("size") < F.col("big_size")) | ((F.col("size") == F.col("big_size")) & (F.col("c") > F.col("big")))))
    asked = settle(few_tasks(asked.select("id", "big").distinct(), rows), f"{name}-asked")
    across_big = None if asked.isEmpty() else links_to_big(asked, found, sizes, texts, percent, shingle, f"{name}-big", whole)

    loose = known.where("size = 0")
    if crowded is not None:
        hot = settle(few_tasks(loose.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= CROWD).select("key"), rows), f"{name}-hot")
        if hot.isEmpty():
            crowded = None
    if crowded is not None:
        many = settle(few_tasks(loose.join(broadcastable(hot), "key").select("id", "c").distinct(), rows), f"{name}-many")
        loose = loose.join(broadcastable(hot), "key", "left_anti")
    # a pair meets under many keys; only the least of those it shares brings it forth
    own = few_tasks(loose.groupBy("id", "n", "c", *carry).agg(F.collect_set("key").alias("keys")), rows)
    mixed = settle(own.select("id", "n", "c", *carry, "keys", F.explode("keys").alias("key")), f"{name}-mixed")
    discard(known)
    x, y = (mixed.select("key", F.col("id").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in ("n", "c", "keys", *carry)]) for i in "ab")
    apart = (F.col("a") > F.col("b")) & (F.col("c_a") != F.col("c_b")) & similar_enough("n_a", "n_b", percent)
    if alike is not None:
        apart = apart & alike
    across = x.join(y, "key").where(apart & (F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b")))).select("a", "b")
    if crowded is not None:
        across = across.unionAll(crowded(many, f"{name}-crowded"))
    rest = across.select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    links = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(confirm(rest, "2"))
    if across_big is not None:
        links = links.unionAll(across_big)
    return settle(components(links, "a", "b", f"{name}-2"), f"{name}-final")
