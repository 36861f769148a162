"""Importance resampling, Merkle manifests and quality rules against brute force and on edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest, ordering, quality, resampling

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"Word{i % 997}x{i % 13}" for i in range(200_000))  # longer than a piece
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "x"), (5, "Hello, World! Hello, World!"), (5, "Hello, World! Hello, World!"), (7, LONG), (8, " ".join(f"a{i}" for i in range(30))), (9, "naïve café 中文 😀 ▁▁ a  b " * 9),
    (None, " ".join(f"b{i}" for i in range(25))), (11, "w" * 300 + " " + "v" * 70 + " tail " + " ".join("abcdefghijklmnopqrstuv")), (12, "a" * 5000), (13, "one two three four five six seven eight nine ten " * 4), (5, "another text of the same id"),
    (14, "line one\nline two\nline one\n\n \nline one "), (15, "a b c d e f g h a b c d e f g h"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, at long, block string, _0 int, domain string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 3 == 0 else "de" if k % 3 == 1 else "", "https://www.Example.com/x" if k % 2 else None, k, 0, 0, "z", 0, "y") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def target(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet").withColumn("doc_id", F.lit(None).cast("long"))


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features(text, max_run):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, max_run + 1) for i in range(len(w) - k + 1)]


def brute_scores(rows, target, max_run=2):
    have, want = [features(t, max_run) for _, t in rows], Counter(b for t in target for b in features(t, max_run))
    own = Counter(b for x in have for b in x)
    s, t = sum(own.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in own}
    out = []
    for (i, text), x in zip(rows, have):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in x) // len(x) if x else 0
        out.append([i, len(words_of(text)), len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: 25 * len(able) // 100], 1):
        x[5] = k
    return sorted(map(str, out))


@pytest.mark.parametrize("max_run", [1, 2, 3])
def test_importance_equals_brute_force(odd, none, docs, target, max_run):
    passages = [r.text for r in target.collect()]
    for df in (odd, none, docs.limit(40)) if max_run == 2 else (odd,):
        got = resampling.importance(df, target, max_run=max_run)
        assert sorted(str(list(r)) for r in got.collect()) == brute_scores([(r.doc_id, r.text) for r in df.collect()], passages, max_run)


def test_importance_without_a_target_and_the_documents_drawn(odd, none, docs, target):
    got = resampling.importance(odd, none).collect()
    assert len(got) == len(ODD)
    drawn = resampling.resample(docs, target)
    want = {r.doc_id for r in resampling.importance(docs, target).where("rank IS NOT NULL").collect()}
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == want and len(want) == sum(len(words_of(r.text)) >= 20 for r in docs.collect()) // 4


def test_checksums_of_joined_words():
    shift, words = resampling.Shift(), resampling.Words()
    run = [b"a", b"word", b"x" * 63, b"y" * 64, b"z" * 65, b"q" * 100_000, "é中".encode(), b"end"]
    ids = np.array([words[w] for w in run])
    got = list(resampling.run_buckets(words, shift, ids, np.zeros(len(run), np.int64), 0, 3, 1 << 32))
    for k in (1, 2, 3):
        assert got[k - 1][0].tolist() == [zlib.crc32(b" ".join(run[i : i + k])) for i in range(len(run) - k + 1)]


def test_places_in_order(spark):
    df = spark.range(5_000).selectExpr("id", "id % 7 AS k")
    got = ordering.number_rows(df, [F.desc("k"), F.asc("id")], "numbered").orderBy("at").collect()
    assert [r.at for r in got] == list(range(5_000)) and [(r.k, r.id) for r in got] == sorted(((i % 7, i) for i in range(5_000)), key=lambda x: (-x[0], x[1]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """Root, and each leaf's siblings level by level as (left, right)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 8])))
        level, at = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 71, 511, 512, 513, 585, 1000, 4095, 4096])
def test_traversal_equals_the_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    height = manifest.height_of(n)
    root, paths = brute_tree(leaves)
    assert manifest.root_of(leaves, height) == root
    assert [list(zip(left, right)) for left, right in manifest.traversal(leaves, height)] == paths
    assert all(len(run) < 8 for run in manifest.Treehash(height).stack)


def brute_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    trees = {}
    for r in rows:
        leaf = sha("".join(field(r[c]) for c in manifest.FIELDS))
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf, r.doc_id))
    parts = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {p: brute_tree([x[2] for x in sorted(trees[p], key=lambda x: x[:3])]) for p in parts}
    root, upper = brute_tree([made[p][0] for p in parts])
    return sorted((str(x[3]), x[2], made[p][0], root, str(path + up)) for p, up in zip(parts, upper) for x, path in zip(sorted(trees[p], key=lambda x: x[:3]), made[p][1]))


def test_manifest_equals_brute_force(odd, none, docs, monkeypatch):
    for df in (odd, none, docs, docs.limit(1)):
        got = manifest.manifest(df).withColumn("back", manifest.folded(F.col("leaf"))).collect()
        found = sorted((str(r.id), r.leaf, r.subroot, r.root, str([(x.left, x.right) for x in r.proof])) for r in got)
        assert found == (brute_manifest(df.collect()) if got else [])
        assert all(r.back == r.root for r in got)


def test_manifest_of_many_blocks(spark):
    """Trees of several blocks and one of a block and a leaf; more trees than a block has nodes would only add rounds."""
    n = 3 * manifest.BLOCK + 77
    rows = spark.range(n).selectExpr("id AS doc_id", f"CASE WHEN id <= {manifest.BLOCK} THEN 'b' ELSE 'a' END AS lang")
    got = manifest.manifest(rows, fields=("doc_id", "lang")).withColumn("back", manifest.folded(F.col("leaf"))).orderBy("id").collect()
    made = {p: [sha(f"{len(str(i))}:{i}1:{p}") for i in ids] for p, ids in (("a", range(manifest.BLOCK + 1, n)), ("b", range(manifest.BLOCK + 1)))}
    roots = {p: brute_tree(x) for p, x in made.items()}
    root = sha(roots["a"][0] + roots["b"][0])
    assert len(got) == n and all(r.root == r.back == root for r in got)
    for i, r in ((0, got[0]), (manifest.BLOCK, got[manifest.BLOCK]), (n - 1, got[-1])):
        p = "b" if i <= manifest.BLOCK else "a"
        at = i if p == "b" else i - manifest.BLOCK - 1
        assert [(x.left, x.right) for x in r.proof][:-1] == roots[p][1][at] and r.subroot == roots[p][0]


def test_many_parts(spark):
    rows = spark.range(6_000).selectExpr("id AS doc_id", "CAST(id % 5000 AS string) AS lang")
    got = manifest.manifest(rows, fields=("doc_id",)).withColumn("back", manifest.folded(F.col("leaf"))).collect()
    assert len(got) == 6_000 and {r.back for r in got} == {got[0].root}


def test_changed_records_are_told(docs):
    made = manifest.manifest(docs).withColumn("changed", F.when(F.col("id") % 5 == 0, F.sha2(F.lit(b"other"), 256)).otherwise(F.col("leaf")))
    bad = {r.id for r in made.where(manifest.folded(F.col("changed")) != F.col("root")).collect()}
    assert bad == {r.doc_id for r in docs.collect() if r.doc_id % 5 == 0}


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    covered = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(odd, none, docs):
    for df in (odd, none, docs):
        got = quality.measured(df, ["doc_id", "text"]).collect()
        assert len(got) == df.count() and all(tuple(r[m] for m in quality.MEASURES) == brute_measures(r["_1"]) for r in got)


def test_measures_of_random_words():
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(["a", "b", "c"][: 1 + k % 3], size=k % 60)) for k in range(300)]
    got = quality.measured_batch([t.encode() for t in texts])
    assert [tuple(int(x[i]) for x in got) for i in range(300)] == [brute_measures(t) for t in texts]


def test_bad_hosts_go_and_good_ones_stay(spark, odd, none):
    good, bad = "plain words that say something new each time and never the same " + " ".join(f"w{i}" for i in range(20)), "buy now"
    rows = [(i, good if i % 10 else bad, "https://news.good.org/a") for i in range(400)]
    rows += [(1000 + i, bad if i % 10 else good, f"https://x{i % 7}.spam.com/a") for i in range(400)]
    rows += [(2000, bad, "https://one.net/"), (2001, good, "https://one.net/"), (2002, good, None), (2003, good, "named")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"domain": F.lit("clash"), "_bad": F.lit(1), "n_words": F.lit(5)})
    verdicts = {r.domain: r.rejected for r in quality.domain_verdicts(quality.judge(df)).where("rule = 'short'").collect()}
    assert verdicts == {"good.org": False, "spam.com": True, "one.net": False, "named": False}
    want = {i for i, t, s in rows if t == good and "spam" not in (s or "")}
    assert {r.doc_id for r in quality.judge(df).where("kept").collect()} == want
    kept = quality.keep_good_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want
    for other in (odd, none):
        assert quality.judge(other).count() == other.count() and quality.keep_good_documents(other).columns == other.columns
