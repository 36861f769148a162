"""Corpus queries against their SQL on the small tables, row by row; nothing is left behind but results."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from tidemark.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = Q.QUERIES[name](spark, DATA)
    found = con.execute(Q.ORACLE_SQL[name])
    columns = sorted(got.columns)
    named = [d[0] for d in found.description]
    assert sorted(named) == columns
    rows = Counter(tuple(str(r[c]) for c in columns) for r in got.collect())
    assert rows == Counter(tuple(str(r[named.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", ["op1_shard", "op2_bpe", "op3_token_counts", "op4_warc_fixity", "op5_near_duplicates", "op6_repeated_passages", "op7_decontaminate", "op9_url_filter", "op11_resample", "op12_manifest", "op13_quality"])
def test_only_the_result_is_left(spark, name):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    Q.QUERIES[name](spark, DATA).count()
    left = [x for x in set(os.listdir(shared)) - before if os.listdir(f"{shared}/{x}")]
    assert len(left) <= 1 and not spark.catalog.listTables()
