"""Operator 4: url rules and empirical-Bayes host reputation.

A rule (host/path-prefix) fits its host and all its subdomains where the url's path starts with the rule's; the longest
rule wins. Urls without a rule are judged by their host. Pages have labelled outcomes (1 bad, 0 good, null unlabelled); each
host's rate of bad pages is shrunk through beta-binomial priors: all pages -> suffix -> registered domain -> host. The strength of
each level's prior comes from the spread of the rates at that level (method of moments). A host is blocked if the lower
bound of its posterior rate lies above ``block_ratio`` times the rate of all pages: it is worse than pages are anyway, and
surely so. A host without labelled pages has its domain's posterior. The suffix is a host's last label, or its last two where these are in
``SECOND_LEVEL``; the registered domain has one label more; an address of four numbers is a domain of its own.

Only counts per host leave the scan, pre-aggregated by task and written once, so a host may hold any share of the pages. Verdicts
come back to pages by a broadcast where hosts are few; where they are many, hosts of more than ``HEAVY`` pages are broadcast (at
most one in ``HEAVY`` pages has such a host) and the rest are joined by host.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and the verdict of the host ''; a null html is
unlabelled; repeated rows repeat their result; an empty table gives no rows; extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stash

#: rule -> verdict, as agreed for the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
Z = 1.645
BLOCK_RATIO = 1.0
#: Public suffixes of two labels that are taken as one.
SECOND_LEVEL = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "net.au", "ne.jp", "or.jp", "org.au", "org.uk")
_ADDRESS = r"^[0-9]+(\.[0-9]+){3}$"
BROADCAST_ROWS, HEAVY = 1 << 18, 1 << 20
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
#: A page is bad where symbols make up at least this share of its visible characters.
BAD_SYMBOLS = 0.05
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. ``rules`` is a short list, part of the plan."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        where, prefix = rule.split("/", 1)
        fits = ((host == where) | host.endswith("." + where)) & path.startswith("/" + prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def symbol_outcome(html: Column, share: float = BAD_SYMBOLS) -> Column:
    """1 for a page whose visible text is full of symbols, 0 for another, null without html."""
    seen = F.regexp_replace(html, "<[^>]*>", "")
    return (F.length(seen) - F.length(F.translate(seen, "#*$%|", "")) >= share * F.length(seen)).cast("int")


def _strength(counts: DataFrame, level: str) -> DataFrame:
    """One row: the prior's strength from the spread of rates over the groups of a level."""
    g = counts.groupBy(level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    s = g.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("sq"))
    mean = F.col("bad") / F.col("n")
    spread = F.col("sq") / F.col("n") - mean * mean - mean * (1 - mean) * F.col("groups") / F.col("n")
    raw = F.when(spread > 0, mean * (1 - mean) / spread - 1).otherwise(F.lit(MOST_STRENGTH))
    return s.select(F.coalesce(F.least(F.greatest(raw, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)), F.lit(MOST_STRENGTH)).alias(f"k_{level}"), F.coalesce(mean, F.lit(0.0)).alias("mean_all"))


def _domains(hosts: DataFrame) -> DataFrame:
    host = F.col("host")
    two, address = F.substring_index(host, ".", -2), host.rlike(_ADDRESS)
    second = two.isin(list(SECOND_LEVEL)) & (host != two)
    domain = F.when(address, host).when(second, F.substring_index(host, ".", -3)).otherwise(two)
    return hosts.withColumns({"domain": domain, "suffix": F.when(address, F.lit("")).when(second, two).otherwise(F.substring_index(host, ".", -1))})


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def host_reputation(pages: DataFrame, z: float = Z) -> DataFrame:
    """(host, pages, rate, low, overall) of every host of ``pages`` (host, outcome): posterior mean, its lower bound, and the rate of all pages."""
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad"))
    hosts = stash(_domains(hosts), "hosts")
    seen = hosts.where("n > 0")
    out, prior = hosts, F.col("mean_all")
    for level in ("suffix", "domain", "host"):  # a single row each, so a broadcast of one row
        k = _strength(seen, level)
        out = out.join(F.broadcast(k if level == "suffix" else k.drop("mean_all")))
    for level in ("suffix", "domain"):
        g = stash(hosts.groupBy(level).agg(F.sum("n").alias(f"n_{level}"), F.sum("bad").alias(f"bad_{level}")), "reputation")
        out = out.join(_small(g), level)
        prior = (F.col(f"bad_{level}") + F.col(f"k_{level}") * prior) / (F.col(f"n_{level}") + F.col(f"k_{level}"))
    a, b = F.col("bad") + F.col("k_host") * F.col("prior"), F.col("n") - F.col("bad") + F.col("k_host") * (1 - F.col("prior"))
    out = out.withColumn("prior", prior).withColumn("a", a).withColumn("b", b)
    total = F.col("a") + F.col("b")
    rate, sd = F.col("a") / total, F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return out.select("host", "pages", rate.alias("rate"), (rate - z * sd).alias("low"), F.col("mean_all").alias("overall"))


def judge_urls(pages: DataFrame, rules: dict[str, str], block_ratio: float = BLOCK_RATIO, broadcast_rows: int = BROADCAST_ROWS, heavy: int = HEAVY) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages`` (page_id, url, outcome)."""
    p = pages.select("page_id", "outcome", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    verdicts = host_reputation(p.select("host", "outcome"))
    verdicts = stash(verdicts.select("host", "pages", F.when(F.col("low") > block_ratio * F.col("overall"), "block").otherwise("allow").alias("judged")), "verdicts")
    p = p.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("rule"))
    if verdicts.count() <= broadcast_rows:
        met = p.join(F.broadcast(verdicts.drop("pages")), "host")
    else:
        large, small = verdicts.where(F.col("pages") > heavy).drop("pages"), verdicts.where(F.col("pages") <= heavy).drop("pages")
        large = F.broadcast(large) if large.count() <= broadcast_rows else large
        met = p.join(large, "host").unionByName(p.join(large, "host", "left_anti").join(small, "host"))
    stated = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        stated = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(stated)
    return met.select("page_id", "host", "path", "rule", F.coalesce(stated, "judged").alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge_urls(pages.select("page_id", "url", symbol_outcome(F.col("html")).alias("outcome")), RULES)


def _level_sql(level: str) -> str:
    return f"""k_{level} AS (SELECT coalesce(least(greatest(CASE WHEN sp > 0 THEN m * (1 - m) / sp - 1 ELSE {MOST_STRENGTH} END, {LEAST_STRENGTH}), {MOST_STRENGTH}), {MOST_STRENGTH}) AS k_{level}, coalesce(m, 0) AS m_{level}
  FROM (SELECT m, sq / n - m * m - m * (1 - m) * g / n AS sp FROM (SELECT n, g, sq, bad / n AS m FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, count(*) AS g, sum(CAST(bad * bad AS DOUBLE) / n) AS sq
    FROM (SELECT {level}, sum(n) AS n, sum(bad) AS bad FROM h WHERE n > 0 GROUP BY {level})))))"""


def _rule_sql() -> str:
    out = ""
    for rule in sorted(RULES, key=lambda r: (-len(r), r)):
        where, prefix = rule.split("/", 1)
        out += f" WHEN (host = '{where}' OR ends_with(host, '.{where}')) AND starts_with(path, '/{prefix}') THEN '{rule}'"
    return f"CASE{out} END"


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    CAST(length(seen) - length(translate(seen, '#*$%|', '')) >= {BAD_SYMBOLS} * length(seen) AS INT) AS outcome
  FROM (SELECT *, regexp_replace(html, '<[^>]*>', '', 'g') AS seen FROM pages)),
hl AS (SELECT *, regexp_matches(host, '{_ADDRESS}') AS address, len(ls) > 2 AND ls[-2] || '.' || ls[-1] IN {SECOND_LEVEL} AS second FROM (SELECT host, string_split(host, '.') AS ls, count(outcome) AS n, coalesce(sum(outcome), 0) AS bad FROM p GROUP BY host)),
h AS (SELECT host, n, bad, CASE WHEN address OR len(ls) <= 2 THEN host WHEN second THEN ls[-3] || '.' || ls[-2] || '.' || ls[-1] ELSE ls[-2] || '.' || ls[-1] END AS domain,
  CASE WHEN address THEN '' WHEN second THEN ls[-2] || '.' || ls[-1] ELSE ls[-1] END AS suffix FROM hl),
{_level_sql("suffix")}, {_level_sql("domain")}, {_level_sql("host")},
s AS (SELECT suffix, (sum(bad) + k_suffix * m_suffix) / (sum(n) + k_suffix) AS pr FROM h, k_suffix GROUP BY suffix, k_suffix, m_suffix),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
dp AS (SELECT domain, (bad + k_domain * pr) / (n + k_domain) AS pr FROM dm JOIN s USING (suffix), k_domain),
ab AS (SELECT host, bad + k_host * pr AS a, n - bad + k_host * (1 - pr) AS b FROM h JOIN dp USING (domain), k_host),
low AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab),
r AS (SELECT page_id, host, path, {_rule_sql()} AS rule FROM p)
SELECT page_id, host, path, rule, coalesce(CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())} END, CASE WHEN low > {BLOCK_RATIO} * m_suffix THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN low USING (host), k_suffix
"""
