"""URL rules and empirical-Bayes host reputation (DataFrame functions only).

Explicit rules (host suffix and path prefix, longest wins) decide first. Every other page is judged by
its host: labelled page outcomes are counted per host, registered domain and public suffix, and each
level's rate of good pages is shrunk towards its parent by a beta-binomial prior whose strength is the
method-of-moments estimate over that level, but no more than ``MOST_STRENGTH`` labelled pages, so that a host
with many outcomes of its own is judged by them. A page passes if the lower posterior bound of its host's
rate (mean - z * sd) reaches ``floor``. Counts are partial aggregates, so a host that holds a third
of all pages costs one row per task; the number of pages never meets in one place.

The levels leave out user names and ports. A public suffix has one label, or two if it is one of
``SUFFIXES`` (co.uk); the registered domain has one label more. Addresses in numbers are domains of their own,
under the empty suffix.

Defined cases: null or scheme-less urls have host and path '' and are judged by the overall rate;
a host without labels takes its domain's posterior, a domain without labels its suffix's; without any
label the rate is 1/2 with a weak prior; urls of any length are read whole; a bound equal to the floor passes;
repeated pages are judged alike, one row each, and each counts its outcome; outcomes that repeat a key count by
their mean; an empty table gives an empty result; pages may have any other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Public suffixes of two labels.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "ac.nz", "co.jp", "ne.jp", "or.jp",
    "ac.jp", "go.jp", "co.kr", "or.kr", "com.br", "org.br", "gov.br", "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "com.tw", "org.tw", "com.hk", "com.sg",
    "com.my", "co.in", "net.in", "org.in", "ac.in", "gov.in", "co.id", "co.th", "com.tr", "com.mx", "com.ar", "com.co", "com.pe", "co.za", "org.za", "co.il", "com.ua", "com.pl",
)
#: Labelled pages that a prior counts for at most; the lower bound's distance in standard deviations; the least bound that passes.
MOST_STRENGTH, Z, FLOOR = 20.0, 1.645, 0.7
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    host = common.ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))
    return host, F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, both null if none does; of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host as it stands in a url."""
    bare = F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":[0-9]*\z", "")
    two = F.substring_index(bare, ".", -2)
    listed = two.isin(*SUFFIXES)
    number = bare.rlike(r"\A([0-9.]+|\[.*)\z")
    domain = F.when(number, bare).when(listed, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, F.when(number, F.lit("")).when(listed, two).otherwise(F.substring_index(bare, ".", -1))


def _strength(groups: DataFrame, parent: str, most: float) -> float:
    """Beta-binomial prior strength from E[n (p - m)^2] = m (1 - m) (1 + (n - 1) rho), strength = 1 / rho - 1."""
    m = F.col(parent)
    v = F.greatest(m * (1 - m), F.lit(1e-9))
    row = groups.filter("n > 0").agg(
        F.sum((F.col("k") / F.col("n") - m) * (F.col("k") / F.col("n") - m) * F.col("n") / v - 1).alias("over"), F.sum(F.col("n") - 1).alias("free")
    ).first()
    rho = row["over"] / row["free"] if row["free"] else 0.1
    rho = min(max(rho, 1e-4), 0.99)
    return min(most, 1 / rho - 1)


def host_reputation(spark: SparkSession, hosts: DataFrame, z: float = Z, most: float = MOST_STRENGTH) -> DataFrame:
    """hosts(host, n, k): labelled pages and good ones of each host -> host, rate, bound."""
    domain, suffix = levels(F.col("host"))
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = (float(total["k"] or 0) + 1) / (float(total["n"] or 0) + 2)

    def shrunk(groups: DataFrame, prior: str, out: str) -> DataFrame:
        s = _strength(groups, prior, most)
        return groups.withColumn(out, (F.col("k") + s * F.col(prior)) / (F.col("n") + s)).withColumn("strength", F.lit(s))

    suffixes = shrunk(suffixes.withColumn("m0", F.lit(base)), "m0", "m_suffix")
    domains = shrunk(domains.join(suffixes.select("suffix", "m_suffix"), "suffix"), "m_suffix", "m_domain")
    hosts = shrunk(hosts.join(domains.select("domain", "suffix", "m_domain"), ["domain", "suffix"]), "m_domain", "rate")
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return hosts.select("host", "rate", (F.col("rate") - z * sd).alias("bound"))


def page_key(url: Column) -> Column:
    """The number that ends a url's path (before an extension or a slash): the key of the document that the page shows; null if there is none."""
    return F.regexp_extract(split_url(url)[1], r"/([0-9]{1,18})(?:\.[a-z]+)?/?\z", 1).try_cast("long")


def judge(spark: SparkSession, pages: DataFrame, outcomes: DataFrame, rules=RULES, floor: float = FLOOR) -> DataFrame:
    """pages(page_id, url), outcomes(key, good 0/1; page_key names a page's) -> page_id, host, path, rule, verdict."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), page_key(F.col("url")).alias("key"))
    good = outcomes.filter("key IS NOT NULL AND good IS NOT NULL").groupBy("key").agg(F.avg(F.col("good").cast("double")).alias("good"))
    # pages of one host and key count together before they meet the outcomes, so a hot key moves as few rows
    shown = urls.groupBy("host", "key").agg(F.count(F.lit(1)).alias("m"))
    counts = (
        shown.join(good, "key", "left")
        .groupBy("host").agg(F.sum(F.when(F.col("good").isNotNull(), F.col("m")).otherwise(F.lit(0))).alias("n"), F.coalesce(F.sum(F.col("good") * F.col("m")), F.lit(0.0)).alias("k"))
    )
    hosts = common.stage(spark, counts, "hosts")
    known = common.stage(spark, host_reputation(spark, hosts).select("host", (F.col("bound") >= floor).alias("passes")), "reputations")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("passes"), F.lit("allow")).otherwise(F.lit("block"))
    return urls.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"))


def labelled_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document that its path names; its outcome is that document's quality."""
    return common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("good"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, common.table(spark, sf_dir, "pages"), labelled_outcomes(spark, sf_dir))


def _strength_sql(groups: str) -> str:
    return f"""(SELECT least({MOST_STRENGTH}::DOUBLE, 1 / coalesce(least(greatest(
    sum((k / n - m) ** 2 * n / greatest(m * (1 - m), 1e-9) - 1) / nullif(sum(n - 1), 0), 1e-4), 0.99), 0.1) - 1) AS s FROM {groups} WHERE n > 0)"""


SQL = {
    "op8_url_reputation": rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
l AS (SELECT doc_id AS key, avg(quality::DOUBLE) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
x AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare, good
  FROM u LEFT JOIN l ON try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.[a-z]+)?/?$', 1), '') AS BIGINT) = key),
y AS (SELECT host, good, bare, regexp_matches(bare, '^([0-9.]+|\[.*)$') AS number,
  array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') AS two FROM x),
h AS (
  SELECT host, CASE WHEN number THEN bare WHEN two IN {SUFFIXES} THEN array_to_string(list_slice(string_split(bare, '.'), -3, -1), '.') ELSE two END AS domain,
         CASE WHEN number THEN '' WHEN two IN {SUFFIXES} THEN two ELSE array_to_string(list_slice(string_split(bare, '.'), -1, -1), '.') END AS suffix,
         count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS k
  FROM y GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
b AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS m FROM s),
s1 AS (SELECT s.*, m FROM s, b),
rs AS {_strength_sql("s1")},
s2 AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM s1, rs),
d1 AS (SELECT d.*, s2.m FROM d JOIN s2 USING (suffix)),
rd AS {_strength_sql("d1")},
d2 AS (SELECT domain, suffix, (k + s * m) / (n + s) AS m FROM d1, rd),
h1 AS (SELECT h.*, d2.m FROM h JOIN d2 USING (domain, suffix)),
rh AS {_strength_sql("h1")},
h2 AS (SELECT host, n, s, (k + s * m) / (n + s) AS rate FROM h1, rh),
h3 AS (SELECT host, rate - {Z} * sqrt(rate * (1 - rate) / (n + s + 1)) >= {FLOOR} AS passes FROM h2),
r AS (
  SELECT u.*, passes, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u JOIN h3 USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
  WHEN rule IS NOT NULL OR passes THEN 'allow' ELSE 'block' END AS verdict
FROM r"""
}
QUERIES = {"op8_url_reputation": op8_url_reputation}
