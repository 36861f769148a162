"""URL verdicts from rules and from the empirical-Bayes reputation of hosts, in DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host; hosts roll up to registered domains, these to
suffixes and these to everything. On each level the children of a parent follow a beta-binomial law
around the parent's mean; the strength of that prior comes from the data by the method of moments: with
rho the correlation of two outcomes in one child, E[(k - n p)^2] = n p (1 - p) (1 + (n - 1) rho), and
strength = 1 / rho - 1. A host's posterior is Beta(k + strength * m, n - k + strength * (1 - m)) with m
the shrunken mean of its domain. A page is blocked if the lower bound of its host's posterior (mean less
z deviations) exceeds max_bad, so that a few bad outcomes on an otherwise unseen host don't block it.

A suffix is a top-level domain, or the last two labels where a country's domain follows a label that registries use
(co.uk, com.cn), or one of the suffixes below which anyone registers (github.io). ``suffixes`` gives others, or is a table
of them (column suffix) as public lists have them: names of any number of labels, *.name for every label below a name,
!name for what is none all the same. A host's suffix is then the longest that fits, else its last label.

The longest rule that fits wins, of equal ones that of the longer host, then block. A few rules are one CASE; more, and
tables of rules (action, host, path), are joined: a host's label suffixes meet the rules' hosts, and prefixes of the path,
of the lengths that such a host's rules have, meet the rules themselves. Their number isn't bounded.

Counts are summed before any shuffle and written once; only (page_id, url) and one row a host meet in the join, whose hot
hosts Spark splits. The settled bounds of hosts stay in the shared folder for the result to read.

Edge cases: a null url, or one without "://", has empty host and path and gets the posterior of the empty
host; without labels at all the prior is prior_bad and nothing is blocked; repeated pages and labels each
count (a page stands once for each of its labels); empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcastable, discard, settle, table

#: (action, host, path); a rule is written host + path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: So many rules are compiled into one CASE; more are joined, with the same results.
MAX_RULES = 1_000
# fixed values: labels under which registries of countries let domains be registered, and suffixes open to anyone
REGISTRY_LABELS = ("ac", "co", "com", "ed", "edu", "go", "gob", "gouv", "gov", "gv", "id", "ltd", "me", "mil", "ne", "net", "nic", "nom", "or", "org", "plc", "sch")
OPEN_SUFFIXES = ("appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "firebaseapp.com", "fly.dev", "github.io", "gitlab.io", "glitch.me", "herokuapp.com", "myshopify.com", "netlify.app", "onrender.com", "pages.dev", "readthedocs.io", "surge.sh", "vercel.app", "web.app", "wixsite.com", "wordpress.com", "workers.dev")


def host_of(url):
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def two_labels(host, suffixes=OPEN_SUFFIXES):
    """Whether the suffix of a host has two labels."""
    last = F.substring_index(host, ".", -2)
    return last.rlike(rf"^({'|'.join(REGISTRY_LABELS)})\.[a-z]{{2}}$") | last.isin(*suffixes)


def suffix_of(host, suffixes=OPEN_SUFFIXES):
    return F.when(two_labels(host, suffixes), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host, suffixes=OPEN_SUFFIXES):
    return F.when(two_labels(host, suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matched_rule(host, path, rules):
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("verdict"))).otherwise(out)
    return out


def label_suffixes(host):
    """The host itself, it less its first label, and so on to its last label."""
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """action, host, path of a sequence of rules."""
    fields = ("action", "host", "path")
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, fields)]) for r in rules])))


def with_hits(seen: DataFrame, rules: DataFrame) -> DataFrame:
    """seen (host, path and more) with hit, the struct of matched_rule, by joins. Rules without a host are none; a null path is empty."""
    told = rules.where("host IS NOT NULL").select(F.col("action").alias("verdict"), ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
    told = settle(told.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")), "rules")
    lengths = told.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))  # numbers of characters, few
    sites = seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    below = sites.select("host").distinct().select("host", F.explode(label_suffixes(F.col("host"))).alias("rule_host"))
    ruled = settle(below.join(lengths, "rule_host").select("host", "rule_host", F.explode("lengths").alias("length")), "ruled-hosts")
    met = sites.select("host", "path").join(broadcastable(ruled), "host").where(F.col("length") <= F.length("path"))
    met = met.withColumn("rule_path", F.substring(F.col("path"), F.lit(1), F.col("length"))).join(broadcastable(told), ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("a"), F.length("rule_host").alias("b"), F.col("verdict").alias("verdict"), rule.alias("rule")))
    hits = settle(met.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.struct("best.rule", "best.verdict").alias("hit")), "rule-hits")
    discard(told, ruled)
    return seen.join(broadcastable(hits), ["host", "path"], "left")


def with_domains(hosts: DataFrame, suffixes) -> DataFrame:
    """hosts (host and more, one row a host) with domain and suffix."""
    if not isinstance(suffixes, DataFrame):
        return hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    known = settle(suffixes.select(ascii_lower(F.col("suffix")).alias("entry")).where("entry <> ''").distinct(), "suffixes")
    size = F.size(F.split("host", "[.]"))
    each = hosts.select("host", size.alias("size"), F.posexplode(label_suffixes(F.col("host"))).alias("skipped", "name"))
    parent = F.when(F.col("skipped") + 1 < F.col("size"), F.expr("substring(name, instr(name, '.') + 1)"))
    # an entry, and how many labels its suffix has
    own = F.col("size") - F.col("skipped")
    entries = F.array(F.struct(F.col("name").alias("entry"), own.alias("labels"), F.lit(0).alias("exempt")), F.struct(F.concat(F.lit("*."), parent).alias("entry"), own.alias("labels"), F.lit(0).alias("exempt")), F.struct(F.concat(F.lit("!"), F.col("name")).alias("entry"), (own - 1).alias("labels"), F.lit(1).alias("exempt")))
    fits = each.select("host", F.inline(entries)).join(broadcastable(known), "entry")
    most = settle(fits.groupBy("host").agg(F.max(F.struct("exempt", "labels"))["labels"].alias("labels")), "host-suffixes")
    discard(known)
    n = F.coalesce("labels", F.lit(1))
    last = lambda k: F.array_join(F.slice(F.split("host", "[.]"), -F.least(k, size), F.least(k, size)), ".")
    out = hosts.join(broadcastable(most), "host", "left").withColumns({"domain": last(n + 1), "suffix": last(n)}).drop("labels")
    out.settled_path = most.settled_path
    return out


def prior_strength(children: DataFrame) -> float:
    """From children with n, k and their parent's mean p (0 < p < 1 counts); one number comes to the driver."""
    spread = F.col("p") * (1 - F.col("p"))
    excess = F.sum(F.when(spread > 0, F.pow(F.col("k") - F.col("n") * F.col("p"), 2) / spread - F.col("n")))
    pairs = F.sum(F.when(spread > 0, F.col("n") * (F.col("n") - 1)))
    rho = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.coalesce(excess / F.nullif(pairs.cast("double"), F.lit(0.0)), F.lit(0.001))))
    return children.agg(1 / rho - 1).first()[0]


def reputation(outcomes: DataFrame, prior_bad: float = 0.05, suffixes=OPEN_SUFFIXES) -> DataFrame:
    """host, domain, suffix, n, k, alpha, beta: the posterior of every host of outcomes (host, bad 0/1)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    named = with_domains(hosts, suffixes)
    hosts = counted = settle(named, "hosts")
    discard(named)
    n, k = hosts.agg(F.sum("n"), F.sum("k")).first()
    total = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    by_suffix = shrunk(hosts.groupBy("suffix").agg(*total).withColumn("p", F.lit(k / n if n else prior_bad))).select("suffix", F.col("m").alias("p"))
    by_domain = shrunk(hosts.groupBy("domain", "suffix").agg(*total).join(by_suffix, "suffix")).select("domain", "suffix", F.col("m").alias("p"))
    hosts = hosts.join(by_domain, ["domain", "suffix"])
    strength = F.lit(prior_strength(hosts))
    out = hosts.select("host", "domain", "suffix", "n", "k", (F.col("k") + strength * F.col("p")).alias("alpha"), (F.col("n") - F.col("k") + strength * (1 - F.col("p"))).alias("beta"))
    out.settled_path = counted.settled_path
    return out


def shrunk(children: DataFrame) -> DataFrame:
    strength = F.lit(prior_strength(children))
    return children.withColumn("m", (F.col("k") + strength * F.col("p")) / (F.col("n") + strength))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = 0.2, z: float = 1.645, id_col: str = "page_id", url_col: str = "url", suffixes=OPEN_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_bound. outcomes: page_id and bad (0 or 1, null: unlabelled)."""
    seen = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    labels = outcomes.select(F.col("page_id"), F.col("bad").cast("int").alias("bad"))
    judged = reputation(seen.select("page_id", "host").join(labels, "page_id", "left"), suffixes=suffixes)
    a, b = F.col("alpha"), F.col("beta")
    bound = a / (a + b) - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    bounds = broadcastable(settle(judged.select("host", bound.alias("bad_bound")), "host-bounds"))
    discard(judged)
    if not isinstance(rules, DataFrame) and len(rules) <= MAX_RULES:
        ruled = seen.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    else:
        ruled = with_hits(seen, rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules))
    return ruled.join(bounds, "host", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")).alias("verdict"), "bad_bound")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables label documents, not pages; the label of the document with the page's number stands for the page's outcome: bad if toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


LAST_SQL = "array_to_string(list_slice(string_split(host, '.'), {k}, -1), '.')"
TWO_SQL = f"(regexp_full_match({LAST_SQL.format(k=-2)}, '({'|'.join(REGISTRY_LABELS)})[.][a-z]{{2}}') OR {LAST_SQL.format(k=-2)} IN ({', '.join(repr(x) for x in OPEN_SUFFIXES)}))"
SUFFIX_SQL = f"CASE WHEN {TWO_SQL} THEN {LAST_SQL.format(k=-2)} ELSE {LAST_SQL.format(k=-1)} END"
DOMAIN_SQL = f"CASE WHEN {TWO_SQL} THEN {LAST_SQL.format(k=-3)} ELSE {LAST_SQL.format(k=-2)} END"
STRENGTH_SQL = "(SELECT 1 / least(0.999, greatest(0.001, coalesce(sum(CASE WHEN p * (1 - p) > 0 THEN pow(k - n * p, 2) / (p * (1 - p)) - n END) / nullif(sum(CASE WHEN p * (1 - p) > 0 THEN n * (n - 1) END), 0), 0.001))) - 1 FROM {t})"

OP9_SQL = f"""
WITH seen AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
outcomes AS (SELECT host, CASE WHEN doc_id IS NULL THEN NULL WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS bad FROM seen LEFT JOIN labels ON page_id = doc_id),
hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, {DOMAIN_SQL} AS domain, {SUFFIX_SQL} AS suffix FROM outcomes GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0.05) FROM hosts) AS p FROM hosts GROUP BY suffix),
s1 AS (SELECT suffix, (k + st * p) / (n + st) AS m FROM s0, (SELECT {STRENGTH_SQL.format(t='s0')} AS st)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS p FROM hosts JOIN s1 USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT domain, suffix, (k + st * p) / (n + st) AS m FROM d0, (SELECT {STRENGTH_SQL.format(t='d0')} AS st)),
h0 AS (SELECT host, n, k, m AS p FROM hosts JOIN d1 USING (domain, suffix)),
h1 AS (SELECT host, k + st * p AS a, n - k + st * (1 - p) AS b FROM h0, (SELECT {STRENGTH_SQL.format(t='h0')} AS st)),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)}) r(action, rhost, rpath)),
fits AS (SELECT DISTINCT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM seen) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.2 THEN 'block' ELSE 'allow' END) AS verdict
FROM seen LEFT JOIN h1 USING (host) LEFT JOIN fits USING (host, path)
"""
