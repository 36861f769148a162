"""Rules and suffixes as tables against brute force; stores of WARC files by their names in Spark."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.llm import urlfilter as U
from tidemark.llm import warc
from tidemark.llm.urlfilter import filter_urls

HOSTS = ["example.org", "a.example.org", "notexample.org", "org", "b.a.example.org", "shop.co.uk", "x.shop.co.uk", "co.uk", "www.ck", "a.b.ck", "c.a.b.ck", "me.id", "", "EXAMPLE.org"]
PATHS = ["", "/", "/en/1", "/en/12", "/en", "/EN/1", "/es/x/y", "/ü/z"]
RULES = [("allow", "org", "/"), ("block", "example.org", "/e"), ("block", "example.org", "/en/1"), ("allow", "a.example.org", ""), ("block", "uk", "/ü/"), ("allow", "org", "/en/1"), ("block", "ck", ""), ("allow", "shop.co.uk", "/ü")]


@pytest.fixture(scope="module")
def pages(spark):
    urls = [f"http://{h}{p}?q#f" for h, p in itertools.product(HOSTS, PATHS)] + [None, "", "no scheme", "http://example.org/en/1"]
    return spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, rule string")


def best(host, path, rules):
    """The longest rule that fits, of equal ones that of the longer host, then block."""
    fits = [(len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:][::-1] if fits else (None, "allow")


def labels(spark):
    return spark.createDataFrame([], "page_id long, bad int")


@pytest.mark.parametrize("form", ["few", "table", "many"])
def test_rules_in_any_form(spark, pages, form, monkeypatch):
    rules = RULES
    if form == "table":
        rules = spark.createDataFrame([*RULES, RULES[0], ("allow", None, "/")], "action string, host string, path string").withColumn("page_id", F.lit(1))
    if form == "many":
        monkeypatch.setattr(U, "MAX_RULES", 3)
    rows = filter_urls(pages, labels(spark), rules).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert (r.rule, r.verdict) == best(r.host, r.path, RULES), r


def test_rules_that_are_none(spark, pages):
    none = spark.createDataFrame([], "action string, host string, path string")
    assert {(r.rule, r.verdict) for r in filter_urls(pages, labels(spark), none).collect()} == {(None, "allow")}
    assert filter_urls(pages.limit(0), labels(spark), spark.createDataFrame(RULES, "action string, host string, path string")).count() == 0


def test_suffixes_as_a_table(spark):
    listed = ["uk", "co.uk", "*.ck", "!www.ck", "org", "ID", None, ""]
    hosts = spark.createDataFrame([(h,) for h in dict.fromkeys(h.lower() for h in HOSTS)], "host string")
    found = {r.host: (r.domain, r.suffix) for r in U.with_domains(hosts, spark.createDataFrame([(x,) for x in listed], "suffix string")).collect()}
    assert found == {
        "example.org": ("example.org", "org"), "a.example.org": ("example.org", "org"), "notexample.org": ("notexample.org", "org"), "org": ("org", "org"), "b.a.example.org": ("example.org", "org"),
        "shop.co.uk": ("shop.co.uk", "co.uk"), "x.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "www.ck": ("www.ck", "ck"), "a.b.ck": ("a.b.ck", "b.ck"), "c.a.b.ck": ("a.b.ck", "b.ck"), "me.id": ("me.id", "id"), "": ("", ""),
    }


def test_suffixes_shape_reputations(spark):
    """Below a listed suffix two sites don't share a prior; without it they are one domain."""
    outcomes = spark.createDataFrame([("a.host.zz", 1)] * 30 + [("b.host.zz", 0)] * 30 + [("c.host.zz", 0)], "host string, bad int")
    apart = {r.host: r.domain for r in U.reputation(outcomes, suffixes=spark.createDataFrame([("host.zz",)], "suffix string")).collect()}
    assert apart == {"a.host.zz": "a.host.zz", "b.host.zz": "b.host.zz", "c.host.zz": "c.host.zz"}
    assert {r.domain for r in U.reputation(outcomes).collect()} == {"host.zz"}


def test_stores_by_their_names_in_spark(monkeypatch, tmp_path):
    import pyarrow.fs as fs

    asked = []
    monkeypatch.setattr(fs, "FileSystem", type("Store", (), {"from_uri": staticmethod(lambda uri: asked.append(uri))}))
    for uri in ("s3a://bucket/x", "s3n://bucket/x", "hdfs://host/x", str(tmp_path)):
        warc.file_store(uri)
    assert asked == ["s3://bucket/x", "s3://bucket/x", "hdfs://host/x", str(tmp_path)]
