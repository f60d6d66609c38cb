"""URL filters: rules first, then empirical-Bayes host reputation.

Labelled page outcomes give each host a number of pages and of bad pages. A host's
bad share is shrunk to its registered domain's, that to its suffix's, and that to the
whole table's: each level is a beta prior of the level below, whose weight is
estimated from how much the level's rates differ beyond binomial noise (one-way
analysis of variance), and is the least where that can't be estimated. A prior's mean
is known no better than the labels behind it allow, so the variances of both add up:
few labels in all never make a heavy prior. A host is blocked when its bad share is
over LIMIT with a posterior probability of at least SURE, that is, when the (1 - SURE)
quantile of its beta posterior lies over LIMIT. The probability is a sum over a grid
around the mode on the log-odds scale. Hosts without labels have their domain's prior.

Everything is DataFrame operations. Counts are pre-aggregated by host; the join that
brings reputations back to urls is one that Spark can split if a host is very common.

Defined results: a null url, or one without ``://``, has empty host and path and is
judged as the host ``''``; repeated rows are judged alike; labels of unknown pages and
null labels don't count; of rules of one length the block wins; an empty table gives an
empty result; further columns of pages are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, lower_ascii

#: (verdict, host, path); the query's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of two labels; others are the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")
#: Block if the bad share is over LIMIT with this probability.
LIMIT, SURE = 0.5, 0.95
#: Bounds of a prior's weight, in pages (two: that of a uniform one), and the least that is left of it where its mean is uncertain.
LEAST_WEIGHT, MOST_WEIGHT, LEAST_LEFT = 2.0, 1000.0, 2.0
#: Grid of the posterior: from -10 to 10 deviations by tenths.
GRID = 100
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    last = F.substring_index(host, ".", -1)
    return F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.substring_index(host, ".", -2)).otherwise(last)


def domain_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    labels = F.size(F.split(suffix_of(host, suffixes), r"\."))
    return F.when(labels == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<length, rule, verdict>; null if none does."""
    fits = []
    for verdict, of, start in rules:
        ok = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        fits.append(F.when(ok, F.struct(F.lit(len(of + start)).alias("length"), F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def rule_hits(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """pairs: (host, path), distinct; rules: (verdict, host, path), any number. (host, path, hit) of the pairs that a rule fits, as matched_rule()."""
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = rules.select(F.col("host").alias("of"), F.col("path").alias("start"), F.col("verdict").alias("v"))
    found = pairs.select("host", "path", F.explode(ends).alias("of")).join(named, "of").where(F.col("path").startswith(F.col("start")))
    rule = F.concat("of", "start")
    return found.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("length"), rule.alias("rule"), F.col("v").alias("verdict"))).alias("hit"))


def posterior_over(a: Column, b: Column, limit: float) -> Column:
    """Probability that a share with a Beta(a, b) posterior is over limit."""
    at, width = F.log(a / b), F.sqrt(1 / a + 1 / b) / 10
    plus = lambda t: F.greatest(t, F.lit(0.0)) + F.log(1 + F.exp(-F.abs(t)))
    edge = math.log(limit / (1 - limit))

    def add(acc: Column, i: Column) -> Column:
        t = at + i * width
        f = F.exp(-a * (plus(-t) - plus(-at)) - b * (plus(t) - plus(at)))
        over = F.greatest(F.least((t - edge) / width + 0.5, F.lit(1.0)), F.lit(0.0))
        return F.struct((acc["all"] + f).alias("all"), (acc["over"] + f * over).alias("over"))

    zero = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("over"))
    return F.aggregate(F.sequence(F.lit(-GRID), F.lit(GRID)), zero, add, lambda acc: acc["over"] / acc["all"])


def _left(weight, known: Column) -> Column:
    """A prior's weight where its mean is itself known as well as ``known`` pages allow: variances add up."""
    return F.greatest(1 / (1 / (F.lit(weight) + 1) + 1 / (known + 1)) - 1, F.lit(LEAST_LEFT))


def _weight(level: DataFrame, name: str) -> DataFrame:
    """Weight of the prior over this level's units (n, bad): 1 / intra-class correlation - 1, within bounds."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    sums = level.where("n > 0").agg(F.sum(n).alias("N"), F.sum(bad).alias("K"), F.sum(n * n).alias("NN"), F.sum(bad * bad / n).alias("KK"), F.count(F.lit(1)).alias("M"))
    rate = F.col("K") / F.col("N")
    noise = rate * (1 - rate)
    between = F.col("KK") - F.col("K") * rate - noise * (F.col("M") - 1)
    rho = between / (noise * (F.col("N") - F.col("NN") / F.col("N") - (F.col("M") - 1)))
    # Units that differ no more than noise have the heaviest prior; where nothing tells how they differ, the lightest.
    usable = (noise > 0) & (F.col("N") - F.col("NN") / F.col("N") - (F.col("M") - 1) > 0)
    weight = F.when(rho > 0, F.greatest(F.least(1 / rho - 1, F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT))).otherwise(F.lit(MOST_WEIGHT))
    return sums.select(F.when(usable, weight).otherwise(F.lit(LEAST_WEIGHT)).alias(name), F.coalesce("N", F.lit(0.0)).alias(f"{name}_n"), ((F.coalesce("K", F.lit(0.0)) + 0.5) / (F.coalesce("N", F.lit(0.0)) + 1)).alias(f"{name}_rate"))


def host_reputation(hosts: DataFrame, outcomes: DataFrame, limit: float = LIMIT, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """hosts: (host), one row each; outcomes: (host, n, bad), one row each. Adds mean, and over, the probability of a bad share over limit."""
    named = hosts.join(outcomes, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    named = cut(named.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn("domain", domain_of(F.col("host"), suffixes)))
    domains = named.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Three one-row tables.
    facts = _weight(named, "host_weight").crossJoin(_weight(domains, "domain_weight")).crossJoin(_weight(tops, "suffix_weight")).first()
    root, known, (wh, wd, ws) = facts["host_weight_rate"], facts["host_weight_n"] + 1, (facts[f"{x}_weight"] for x in ("host", "domain", "suffix"))
    tops = tops.select("suffix", "n", "bad", _left(ws, F.lit(known)).alias("w"))
    tops = tops.select("suffix", ((F.col("bad") + F.col("w") * root) / (F.col("n") + F.col("w"))).alias("suffix_mean"), (F.col("n") + F.col("w")).alias("suffix_known"))
    means = domains.join(tops, "suffix").withColumn("w", _left(wd, F.col("suffix_known")))
    means = means.select("domain", "suffix", ((F.col("bad") + F.col("w") * F.col("suffix_mean")) / (F.col("n") + F.col("w"))).alias("domain_mean"), (F.col("n") + F.col("w")).alias("domain_known"))
    shrunk = named.join(means, ["suffix", "domain"]).withColumn("w", _left(wh, F.col("domain_known")))
    shrunk = shrunk.select("host", "n", "bad", (F.col("bad") + F.col("w") * F.col("domain_mean")).alias("a"), (F.col("n") - F.col("bad") + F.col("w") * (1 - F.col("domain_mean"))).alias("b"))
    # Columns of their own, as a lambda works out anew what it takes from outside.
    return cut(shrunk).select("host", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), posterior_over(F.col("a"), F.col("b"), limit).alias("over"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, limit: float = LIMIT, sure: float = SURE, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """outcomes: (page_id, bad 0 or 1), any number a page; rules: a short tuple, or a DataFrame of any size (verdict, host, path). One row per row of pages: page_id, host, path, rule, verdict."""
    url = F.col(f"`{url_col}`")
    parts = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.select(F.col("page_id").alias("label_id"), F.col("bad").cast("long").alias("bad")).where("bad IS NOT NULL")
    known = known.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    counted = parts.join(known, parts["page_id"] == known["label_id"]).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    reputation = cut(host_reputation(parts.select("host").distinct(), counted, limit, suffixes))
    found = parts.join(reputation.select("host", "over"), "host", "left")
    if isinstance(rules, DataFrame):
        found = found.join(rule_hits(parts.select("host", "path").distinct(), rules), ["host", "path"], "left")
    else:
        found = found.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("over") >= sure, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    return judge_urls(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def _sql_weight(level: str) -> str:
    return f"""(SELECT CASE WHEN rate * (1 - rate) > 0 AND size > 0
                  THEN CASE WHEN rho > 0 THEN greatest(least(1 / rho - 1, {MOST_WEIGHT}), {LEAST_WEIGHT}) ELSE {MOST_WEIGHT} END ELSE {LEAST_WEIGHT} END
   FROM (SELECT *, (kk - k * rate - rate * (1 - rate) * (m - 1)) / (rate * (1 - rate) * size) AS rho
         FROM (SELECT *, k / n AS rate, n - nn / n - (m - 1) AS size
               FROM (SELECT sum(n::DOUBLE) n, sum(bad::DOUBLE) k, sum(n::DOUBLE * n) nn, sum(bad::DOUBLE * bad / n) kk, count(*) m
                     FROM {level} WHERE n > 0))))"""


def _sql_left(weight: str, known: str) -> str:
    return f"greatest(1 / (1 / ({weight} + 1) + 1 / ({known} + 1)) - 1, {LEAST_LEFT})"


_SUFFIXES = ", ".join(repr(x) for x in TWO_LABEL_SUFFIXES)

OP3_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, of, start) AS (VALUES {", ".join(repr(r) for r in RULES)}),
hits AS (
  SELECT host, path, of || start AS rule, verdict FROM (SELECT DISTINCT host, path FROM parts), rules
  WHERE (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(of || start) DESC, of || start DESC, verdict DESC) = 1),
counted AS (
  SELECT host, count(*) AS n, sum((toxic = 1 OR quality = 0)::INT) AS bad FROM parts JOIN labels ON page_id = doc_id
  WHERE (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY host),
hosts AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad,
         CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE split_part(host, '.', -1) END AS suffix,
         CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain
  FROM (SELECT DISTINCT host FROM parts) LEFT JOIN counted USING (host)),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
weights AS (SELECT {_sql_weight("hosts")} AS wh, {_sql_weight("domains")} AS wd, {_sql_weight("suffixes")} AS ws,
  (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) FROM hosts) AS root, (SELECT coalesce(sum(n), 0) + 1 FROM hosts) AS known),
s_means AS (SELECT suffix, (bad + w * root) / (n + w) AS m, n + w AS known FROM (SELECT s.*, root, {_sql_left("ws", "weights.known")} AS w FROM suffixes s, weights)),
d_means AS (SELECT domain, suffix, (bad + w * m) / (n + w) AS m, n + w AS known FROM (SELECT d.*, s.m, {_sql_left("wd", "s.known")} AS w FROM domains d JOIN s_means s USING (suffix), weights)),
posts AS (SELECT host, bad + w * m AS a, n - bad + w * (1 - m) AS b FROM (SELECT h.*, d.m, {_sql_left("wh", "d.known")} AS w FROM hosts h JOIN d_means d USING (suffix, domain), weights)),
grid AS (
  SELECT host, a, b, ln(a / b) AS c, sqrt(1 / a + 1 / b) / 10 AS w, ln(a / b) + i * sqrt(1 / a + 1 / b) / 10 AS t
  FROM posts, (SELECT unnest(range(-{GRID}, {GRID} + 1)) AS i)),
dens AS (
  SELECT host, greatest(least((t - {math.log(LIMIT / (1 - LIMIT))}) / w + 0.5, 1.0), 0.0) AS part,
    exp(-a * (greatest(-t, 0) + ln(1 + exp(-abs(t))) - greatest(-c, 0) - ln(1 + exp(-abs(c)))) - b * (greatest(t, 0) + ln(1 + exp(-abs(t))) - greatest(c, 0) - ln(1 + exp(-abs(c))))) AS f
  FROM grid),
overs AS (SELECT host, sum(f * part) / sum(f) AS over FROM dens GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN over >= {SURE} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN hits USING (host, path) LEFT JOIN overs USING (host)
"""
