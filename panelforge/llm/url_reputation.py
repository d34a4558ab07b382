"""URL filters: explicit rules first, then empirical-Bayes reputation of the host.

Pages that a rule decides are labelled outcomes.  A rule that names a path says little about the rest of a host, so a
host's block rate is that of its labelled pages times the share of its pages that rules reach: where rules reach a
host, its other pages count as not blocked.  A host that no rule reaches has no outcomes.  A
host's rate is shrunk towards its registered domain's, the domain's towards its suffix's, and the suffix's towards the
rate of all: each level is beta-binomial, and its prior's strength comes from how much the children's rates differ
(method of moments).  A page without a rule is blocked when its suffix at least has outcomes of its own and the lower
posterior bound of its host's block rate is above one half; the rate of all alone blocks nothing.

Outcomes are aggregated before anything is joined; a frequent host is one row there.  The
pages meet their hosts in one equi-join, whose skewed partitions Spark splits at run time.

Defined results: a null url, or one without ``://``, has an empty host and path; an empty host has no
rule and no outcomes, and is allowed.  A host without outcomes takes its domain's rate, and so on up;
without any labelled page nothing is blocked.  Repeated rows are judged row by row; an empty table stays empty; urls
of any length are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.tables import table, unused

#: (verdict, host, path): fits the host and its subdomains where the path starts so.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of more than one label; any other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "co.in", "co.kr", "co.nz", "co.za", "com.mx", "com.tr")
#: The bound is the posterior mean less so many standard deviations.
BOUND_Z = 1.645
BLOCK_ABOVE = 0.5
#: Limits of a prior's strength, in pages.
STRENGTH = (2.0, 200.0)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, suffix, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(suffix + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and the label before it."""
    return F.when(F.size(F.split(suffix, r"\.")) == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(n: Column, bad: Column) -> Column:
    """Moment estimate of a beta prior's strength from children's labelled and blocked counts."""
    total, blocked, kids = F.sum(n), F.sum(bad), F.count_if(n > 0)
    rate = F.try_divide(blocked, total)
    binomial = rate * (1 - rate)
    spread = F.sum(F.try_divide(bad * bad, n)) - F.try_divide(blocked * blocked, total)
    free = total - F.try_divide(F.sum(n * n), total) - (kids - 1)
    correlation = F.try_divide(spread - binomial * (kids - 1), binomial * free)
    strength = F.when(correlation > 0, F.try_divide(1 - correlation, correlation)).otherwise(STRENGTH[1])
    return F.coalesce(F.greatest(F.least(strength, F.lit(STRENGTH[1])), F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def lower_bound(mean: Column, weight: Column, z: float = BOUND_Z) -> Column:
    """Mean less ``z`` standard deviations of a beta distribution of that mean and weight."""
    return mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))


def host_reputation(pages: DataFrame, host: str = "host", bad: str = "bad") -> DataFrame:
    """host, mean, weight, known: the posterior block rate of every host, how many pages it is worth, and whether its suffix has outcomes.

    ``bad`` is 1 or 0 for a labelled page and null for any other.  A host's unlabelled pages count as 0 if it has labelled ones.
    """
    sums = lambda n, b: [F.sum(n).alias("n"), F.sum(b).alias("bad")]
    suffix = suffix_of(F.col("host"))
    reached = F.when(F.count(bad) > 0, F.count(F.lit(1))).otherwise(0)
    hosts = pages.groupBy(F.col(host).alias("host")).agg(reached.alias("n"), F.coalesce(F.sum(F.col(bad).cast("long")), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), suffix))
    level = lambda df, *keys: df.groupBy(*keys).agg(*sums("n", "bad"), _strength(F.col("n"), F.col("bad")).alias("k"))
    domains = level(hosts, "suffix", "domain")
    suffixes = level(domains, "suffix")
    overall = level(suffixes).select(F.coalesce(F.try_divide("bad", "n"), F.lit(0.0)).alias("mean"), "k")
    # The prior of a level is the posterior of the one above, as strong as that level's own children differ.
    shrunk = lambda prior, k: (F.col("bad") + k * prior) / (F.col("n") + k)
    suffixes = suffixes.join(F.broadcast(overall.withColumnsRenamed({"mean": "prior", "k": "prior_k"})))
    suffixes = suffixes.select("suffix", shrunk(F.col("prior"), F.col("prior_k")).alias("prior"), F.col("k").alias("prior_k"), (F.col("n") > 0).alias("known"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("prior"), F.col("prior_k")).alias("prior"), F.col("k").alias("prior_k"), "known")
    return hosts.join(domains, "domain").select("host", shrunk(F.col("prior"), F.col("prior_k")).alias("mean"), (F.col("n") + F.col("prior_k")).alias("weight"), "known")


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``; columns of these names are replaced."""
    judged = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled, its_host, blocked = (unused(pages, c) for c in ("__ruled", "__host", "__blocked"))
    judged = judged.withColumn("rule", rule).withColumn(ruled, verdict)
    outcomes = judged.select("host", F.when(F.col(ruled).isNotNull(), (F.col(ruled) == "block").cast("int")).alias("bad"))
    reputed = host_reputation(outcomes).select(F.col("host").alias(its_host), (F.col("known") & (lower_bound(F.col("mean"), F.col("weight")) > BLOCK_ABOVE)).alias(blocked))
    by_host = F.when(F.col(blocked), "block").otherwise("allow")
    return judged.join(reputed, F.col("host") == F.col(its_host), "left").withColumn("verdict", F.coalesce(ruled, by_host)).drop(ruled, its_host, blocked)


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _sql() -> str:
    k = """greatest(least(CASE WHEN rho > 0 THEN (1 - rho) / rho ELSE 200.0 END, 200.0), 2.0)"""
    level = lambda source, keys: f"""
      SELECT {keys}{", " if keys else ""}n, bad, {k} AS k FROM (
        SELECT *, (spread - v * (kids - 1)) / nullif(v * (n - sq / nullif(n, 0) - (kids - 1)), 0) AS rho FROM (
          SELECT *, (bad / nullif(n, 0)) * (1 - bad / nullif(n, 0)) AS v, per - bad * bad / nullif(n, 0) AS spread FROM (
            SELECT {keys}{", " if keys else ""}CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, CAST(count(*) FILTER (n > 0) AS DOUBLE) AS kids,
              sum(bad * bad / nullif(n, 0)) AS per, sum(n * n) AS sq FROM {source} {"GROUP BY " + keys if keys else ""})))"""  # noqa: E731
    suffixes = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
    fits = lambda r: f"(host = '{r[1]}' OR host LIKE '%.{r[1]}') AND starts_with(path, '{r[2]}')"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {fits(x)} THEN '{x[1] + x[2]}'" for x in rules)} END AS rule, CASE {" ".join(f"WHEN {fits(x)} THEN '{x[0]}'" for x in rules)} END AS ruled FROM u),
h0 AS (SELECT host, CASE WHEN count(ruled) > 0 THEN CAST(count(*) AS DOUBLE) ELSE 0 END AS n, CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) AS bad, string_split(host, '.') AS parts FROM r GROUP BY host),
h1 AS (SELECT *, CASE WHEN array_to_string(parts[-2:], '.') IN ({suffixes}) THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM h0),
h AS (SELECT *, CASE WHEN contains(suffix, '.') THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain FROM h1),
d AS ({level("h", "suffix, domain")}), s AS ({level("d", "suffix")}), o AS ({level("s", "")}),
sp AS (SELECT suffix, (s.bad + o.k * coalesce(o.bad / nullif(o.n, 0), 0)) / (s.n + o.k) AS m, s.k, s.n > 0 AS known FROM s, o),
dp AS (SELECT domain, (d.bad + sp.k * sp.m) / (d.n + sp.k) AS m, d.k, known FROM d JOIN sp USING (suffix)),
hp AS (SELECT host, (h.bad + dp.k * dp.m) / (h.n + dp.k) AS m, h.n + dp.k AS w, known FROM h JOIN dp USING (domain))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN known AND m - {BOUND_Z} * sqrt(m * (1 - m) / (w + 1)) > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN hp USING (host)
"""


QUERIES = {"op8_url_reputation": op8_url_reputation}
ORACLES = {"op8_url_reputation": _sql()}
