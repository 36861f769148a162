"""Merkle manifest of a dataset: a digest a record, a tree a part, a root over all, and a proof a record.

A record's leaf is the SHA-256 of its fields, each with its length. The records of a part (``tree_col``) are ordered by
``order_col``; of every ``FAN`` consecutive nodes one digest is made, until one is left, the part's subroot. Subroots, in
order of their parts, make the root in the same way. A proof lists, level by level, the digests left and right of a
record's path; ``folded`` turns a leaf and its proof into a root with SQL functions alone.

1. Leaves are hashed where records are read; from here on only digests move. A sort by ranges numbers them.
2. Leaves are packed in aligned blocks of FAN ** BLOCK_LEVELS. A block's root comes from one treehash stack; block roots
   are packed in the same way, up to the root: as many rounds as there are levels of blocks, on 4,096 times fewer rows each.
3. Downwards, a block meets the path of its own root, which all its leaves share, and its leaves are traversed one after the
   other: each level holds the run of nodes around the path and a treehash stack that takes one leaf a step of the run
   ahead, so that the next run is there when the path enters it. A traversal holds 8 + 7 h digests on level h, beside the
   block it reads.

Blocks have a bounded size, so a part may hold any share of the rows. A block that is lost is made again by itself.

Edge cases: a null field is `-`, told from an empty one (`0:`); records without a part make a tree that comes first;
null ids come first in their tree; repeated records are leaves of their own; a tree of one record has its leaf as
subroot and, alone, as root, with an empty proof; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcastable, discard, settle, slices, table, tidied
from .ordering import CRC_TABLE_SQL, crc_sql, number_rows, per_group

FAN, BLOCK_LEVELS = 8, 4
BLOCK = FAN**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"
PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels from n nodes to one."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


class Treehash:
    """Nodes of one level from leaves that come one by one; a stack of unfinished runs a level below."""

    def __init__(self, level: int):
        self.level, self.stack, self.nodes = level, [[] for _ in range(level)], []

    def take(self, leaf: str) -> None:
        for run in self.stack:
            run.append(leaf)
            if len(run) < FAN:
                return
            leaf = digest("".join(run))
            run.clear()
        self.nodes.append(leaf)

    def close(self) -> list[str]:
        """All nodes, the last of which may cover fewer leaves."""
        left = None
        for run in self.stack:
            if left is not None:
                run.append(left)
            left = digest("".join(run)) if run else None
        return self.nodes + ([left] if left is not None else [])


def root_of(leaves: list[str], height: int) -> str:
    top = Treehash(height)
    for leaf in leaves:
        top.take(leaf)
    return top.close()[0]


def traversal(leaves: list[str], height: int):
    """For each leaf in turn, the strings left and right of its path, level by level: two lists that stay the same objects where a level doesn't move."""
    ahead, runs = [Treehash(h) for h in range(height)], []
    for h in range(height):
        first = Treehash(h)
        for leaf in leaves[: FAN ** (h + 1)]:
            first.take(leaf)
        runs.append(first.close())
    left, right = [""] * height, [""] * height
    for i in range(len(leaves)):
        for h in range(height):
            step = FAN**h
            if i % step:
                break
            at = i // step % FAN
            left[h], right[h] = "".join(runs[h][:at]), "".join(runs[h][at + 1 :])
        yield left, right
        for h in range(height):
            span = FAN ** (h + 1)
            if i + span < len(leaves):
                ahead[h].take(leaves[i + span])
            if (i + 1) % span == 0 and i + 1 < len(leaves):
                runs[h], ahead[h] = ahead[h].close(), Treehash(h)


def packed(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes (tree, at, n, digest binary, id, carry) in blocks."""
    return settle(nodes.groupBy("tree", F.expr(f"at div {BLOCK}").alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest", "id", "carry"))).alias("nodes")), name, "snappy")


def climb(nodes: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and the root of each tree as (tree, digest)."""

    def run(batches):
        for batch in slices(batches, 1):
            for r in batch.select(["tree", "block", "n", "digests"]).to_pylist():
                root = root_of([d.hex() for d in r["digests"]], min(BLOCK_LEVELS, height_of(r["n"])))
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]], pa.int64()), pa.array([r["block"]], pa.int64()), pa.array([-(-r["n"] // BLOCK)], pa.int64()), pa.array([bytes.fromhex(root)], pa.binary())], ["tree", "at", "n", "digest"])

    rounds = []
    while True:
        rounds.append(packed(nodes, f"{name}-blocks"))
        roots = rounds[-1].select("tree", "block", "n", F.col("nodes.digest").alias("digests")).mapInArrow(tidied(run), "tree long, at long, n long, digest binary")
        if most <= BLOCK:
            return rounds, settle(roots.select("tree", "digest"), f"{name}-roots")
        nodes, most = roots.select("*", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<binary>").alias("carry")), -(-most // BLOCK)


def descend(rounds: list[DataFrame], upper: DataFrame, id_type, name: str) -> DataFrame:
    """The nodes of the lowest round as (tree, at, id, carry, digest hex, path, top): path runs to where upper (tree, block, path, top) ends."""

    def run(batches):
        for batch in slices(batches, 1):
            for r in batch.to_pylist():
                nodes, shared = r["nodes"], r["path"]
                leaves = [x["digest"].hex() for x in nodes]
                height = min(BLOCK_LEVELS, height_of(r["n"]))
                own_l, own_r = [x["left"] for x in shared], [x["right"] for x in shared]
                depth, at, lefts, rights = height + len(shared), 0, [], []
                for i, (left, right) in enumerate(traversal(leaves, height), 1):
                    lefts += left
                    lefts += own_l
                    rights += right
                    rights += own_r
                    if i - at == 512 or i == len(leaves):
                        some = nodes[at:i]
                        path = pa.ListArray.from_arrays(pa.array([k * depth for k in range(len(some) + 1)], pa.int32()), pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"]))
                        columns = [pa.array([r["tree"]] * len(some), pa.int64()), pa.array([x["at"] for x in some], pa.int64()), pa.array([x["id"] for x in some]), pa.array([x["carry"] for x in some], pa.list_(pa.binary())), pa.array(leaves[at:i], pa.string()), path, pa.array([r["top"]] * len(some), pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, ["tree", "at", "id", "carry", "digest", "path", "top"])
                        at, lefts, rights = i, [], []

    for k, blocks in enumerate(reversed(rounds)):
        kind = id_type if k == len(rounds) - 1 else "bigint"
        out = blocks.join(upper, ["tree", "block"]).select("tree", "block", "n", "nodes", "path", "top").mapInArrow(tidied(run), f"tree long, at long, id {kind}, carry array<binary>, digest string, path {PATH}, top string")
        if k < len(rounds) - 1:
            upper = broadcastable(settle(out.select("tree", F.col("at").alias("block"), "path", "top"), f"{name}-paths", "snappy"))
    return out


def field(name: str):
    value = F.col(name) if isinstance(name, str) else name
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(fields) -> F.Column:
    return F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256)


def manifest(docs: DataFrame, fields=FIELDS, tree_col: str = "lang", order_col: str = "doc_id", carry=()) -> DataFrame:
    """id, carry, leaf, proof (array of left and right, from the leaf up), subroot, root: one row a record.

    carry: binary columns of records that come along as an array. discard_manifest() deletes what the result reads.
    """
    spark = docs.sparkSession
    id_type = docs.select(f"`{order_col}`").schema[0].dataType.simpleString()
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))  # null apart from empty, and first
    leaves = settle(docs.select(tree.alias("tree"), F.col(f"`{order_col}`").alias("id"), F.unhex(leaf_of([F.col(f"`{f}`") for f in fields])).alias("digest"), F.array(*carry).cast("array<binary>").alias("carry")), "leaves", "snappy")
    ordered = number_rows(leaves.withColumn("_place", F.monotonically_increasing_id()), [F.asc("tree"), F.asc_nulls_first("id"), F.asc("digest"), F.asc("_place")], "ordered-leaves").drop("_place")
    trees = settle(per_group(ordered, "tree"), "trees")
    n_trees, most = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    numbered = number_rows(trees, [F.asc("tree")], "ordered-trees", "number")
    listed = settle(numbered, "numbered-trees")
    nodes = ordered.join(broadcastable(listed), "tree").select(F.col("number").alias("tree"), (F.col("at") - F.col("first")).alias("at"), "n", "digest", "id", "carry")
    own, subroots = climb(nodes, most, "manifest")
    empty = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<binary>").alias("carry")]
    above, root = climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_trees).cast("long").alias("n"), "digest", *empty), n_trees, "forest")
    found = root.first()
    top = spark.createDataFrame([(0, 0, [], None)], f"tree long, block long, path {PATH}, top string")
    paths = settle(descend(above, top, "bigint", "forest").select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("top")), "forest-paths", "snappy")
    out = descend(own, broadcastable(paths), id_type, "manifest").select("id", "carry", F.col("digest").alias("leaf"), F.col("path").alias("proof"), F.col("top").alias("subroot"), F.lit(found.digest.hex() if found else None).alias("root"))
    discard(leaves, ordered, trees, numbered, listed, subroots, root, *above)
    out.read = [*own, paths]
    return out


def discard_manifest(made: DataFrame) -> None:
    discard(*made.read)


def folded(leaf, proof="proof"):
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda so_far, x: F.sha2(F.concat(x["left"], so_far, x["right"]).cast("binary"), 256))


def proof_digest(proof="proof"):
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "").cast("binary"), 256)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(touched, F.unhex(leaf_of(["doc_id", "source", "lang", "n_chars", ascii_lower(F.col("text"))])))
    made = manifest(docs, carry=[tampered])
    presented = F.coalesce(F.lower(F.hex(F.col("carry")[0])), F.col("leaf"))
    out = made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded(presented).alias("folded_root"))
    out = settle(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest-digests", "snappy")
    discard_manifest(made)
    return out


def _levels_sql(name: str, most: int) -> str:
    """Levels of all trees of name0 (tree, pos, n, d), with what stands left and right of each node in its run."""
    out = []
    for k in range(most):
        run = f"(PARTITION BY tree, pos // {FAN} ORDER BY pos ROWS BETWEEN"
        out.append(f"{name}s{k} AS (SELECT *, coalesce(string_agg(d, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)")
        out.append(f"{name}{k + 1} AS (SELECT tree, pos // {FAN} AS pos, (n + {FAN - 1}) // {FAN} AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM {name}{k} GROUP BY tree, pos // {FAN}, n)")
    return ",\n".join(out)


def _fold_sql(source: str, name: str, most: int, tree: str, pos: str) -> str:
    """source (r, x, proof, ...) taken up the levels, one step a level."""
    out = []
    for k in range(most):
        out.append(f"{name}f{k + 1} AS (SELECT q.* REPLACE (CASE WHEN s.d IS NULL THEN x ELSE sha256(s.l || x || s.r) END AS x, proof || coalesce(s.l || s.r, '') AS proof) FROM {source if k == 0 else f'{name}f{k}'} q LEFT JOIN {name}s{k} s ON s.tree = q.{tree} AND s.pos = q.{pos} // {FAN**k})")
    return ",\n".join(out)


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH docs AS (SELECT doc_id, lang, sha256({" || ".join(_field_sql(f) for f in FIELDS)}) AS leaf,
    CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({" || ".join(_field_sql(f) for f in (*FIELDS[:-1], LOWER_SQL))}) END AS tampered FROM documents, {CRC_TABLE_SQL}),
parts AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS n_trees FROM (SELECT DISTINCT lang FROM docs)),
placed AS (SELECT docs.*, tree, n_trees, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs JOIN parts ON docs.lang IS NOT DISTINCT FROM parts.lang),
a0 AS (SELECT tree, pos, n, leaf AS d FROM placed),
{_levels_sql("a", 8)},
b0 AS (SELECT 0 AS tree, a8.tree AS pos, (SELECT count(*) FROM a8) AS n, d FROM a8),
{_levels_sql("b", 4)},
start AS (SELECT doc_id, leaf, tree, pos, 0 AS zero, coalesce(tampered, leaf) AS x, '' AS proof FROM placed),
{_fold_sql("start", "a", 8, "tree", "pos")},
{_fold_sql("af8", "b", 4, "zero", "tree")}
SELECT doc_id, leaf, a8.d AS subroot, b4.d AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = b4.d AS verified FROM bf4 q JOIN a8 ON a8.tree = q.tree, b4
"""
