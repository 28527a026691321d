"""URL filter: rules on host and path, and empirical-Bayes host reputation for the rest.

Labelled outcomes (bad or not) are counted by host, by registered domain and by suffix. A
beta-binomial prior is shrunk level by level: the suffix towards all pages, the domain towards
its suffix, the host towards its domain. Each level's strength is estimated from the spread of
its groups by moments. A host is blocked when the lower posterior bound of its bad share is
above a limit, so a host with few labels keeps the benefit of its domain's record.

Only DataFrame functions; of the pages only the id and the url are read. What is joined to the
pages is the list of hosts over the limit.

Edge cases: a null url or one without "://" has empty host and path, fits no rule and is judged
as the host "". Labels are taken by the last integer of the path; several label rows of one
document count once, as bad if any of them is. Null labels count as not bad; a page with no label adds
no outcome. Repeated pages count as often as they occur. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.llm.common import ascii_lower, small_side, table, written

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Reputation:
    max_bad: float = 0.5  #: block when the lower bound of the bad share is above
    z: float = 1.645  #: width of the bound in posterior standard deviations
    least_strength: float = 2.0
    most_strength: float = 1000.0
    two_label_suffixes: tuple[str, ...] = ("co.uk", "com.au", "co.jp")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    out = None
    for verdict, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def registered(host: Column, cfg: Reputation) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    n_suffix = F.when(two.isin(*cfg.two_label_suffixes), 2).otherwise(1) if cfg.two_label_suffixes else F.lit(1)
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), 1_000), ".")
    return last(n_suffix + 1), last(n_suffix)


def strength(groups: DataFrame, p: float, cfg: Reputation) -> float:
    """Beta-binomial strength (prior observations) of groups with counts n, k around share p.

    The sums are over integers (k*k/n in millionths), so the order of rows cannot change it.
    """
    r = groups.where("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"),
        F.sum(F.floor(F.col("k") * F.col("k") * 1_000_000 / F.col("n"))).alias("kk"),
        F.sum(F.floor(F.lit(1_000_000) / F.col("n"))).alias("inv"),
    ).first()
    if not r.g or r.g < 2 or not 0 < p < 1:
        return cfg.most_strength
    spread = r.kk / 1e6 - 2 * p * r.k + p * p * r.n
    s2 = r.g * spread / ((r.g - 1) * r.n)
    within = p * (1 - p) * (r.inv / 1e6) / r.g
    if s2 <= within:
        return cfg.most_strength
    return min(cfg.most_strength, max(cfg.least_strength, (p * (1 - p) - s2) / (s2 - within)))


def host_reputation(outcomes: DataFrame, cfg: Reputation = Reputation()) -> DataFrame:
    """outcomes(host, bad: 0, 1 or null for unlabelled) -> host, n, k, bad_rate, lower, blocked."""
    domain, suffix = registered(F.col("host"), cfg)
    hosts = written(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
        .withColumns({"domain": domain, "suffix": suffix}), "hosts")
    up = lambda df, key: df.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains, suffixes = up(hosts, ["domain", "suffix"]), up(hosts, ["suffix"])
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    p = (total.k + 1) / (total.n + 2) if total.n else 0.0
    m_suffix, m_domain, m_host = (strength(x, p, cfg) for x in (suffixes, domains, hosts))
    shrunk = lambda k, n, m, prior: (F.col(k) + F.lit(m) * prior) / (F.col(n) + F.lit(m))
    suffixes = suffixes.select("suffix", shrunk("k", "n", m_suffix, F.lit(p)).alias("p_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk("k", "n", m_domain, F.col("p_suffix")).alias("p_domain"))
    a, b = F.col("k") + F.lit(m_host) * F.col("p_domain"), F.col("n") - F.col("k") + F.lit(m_host) * (1 - F.col("p_domain"))
    return (
        hosts.join(domains, "domain").select("host", "n", "k", a.alias("a"), b.alias("b"))
        .withColumn("bad_rate", F.col("a") / (F.col("a") + F.col("b")))
        .withColumn("lower", F.col("bad_rate") - cfg.z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("a") + F.col("b") + 1)))
        .select("host", "n", "k", "bad_rate", "lower", (F.col("lower") > cfg.max_bad).alias("blocked"))
    )


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, cfg: Reputation = Reputation()) -> DataFrame:
    """page_id, host, path, rule, verdict: of the longest rule that fits, else of the host's reputation."""
    host, path = url_parts(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    label_id = F.regexp_extract(F.col("path"), r"(\d{1,18})(?!.*\d)", 1)
    bad = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    outcomes = seen.select("host", label_id.try_cast("bigint").alias("label_id"))
    outcomes = outcomes.join(bad, "label_id", "left").select("host", "bad")
    over = written(host_reputation(outcomes, cfg).where("blocked").select("host", F.lit("block").alias("by_host")), "blocked")
    ruled = seen.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    return ruled.join(small_side(over), "host", "left").select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"),
        F.coalesce(F.col("m.verdict"), F.col("by_host"), F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _strength_sql(src: str) -> str:
    return f"""(SELECT CASE WHEN g < 2 OR g IS NULL OR p <= 0 OR p >= 1 THEN 1000.0 WHEN s2 <= w THEN 1000.0
        ELSE least(1000.0, greatest(2.0, (p*(1-p) - s2) / (s2 - w))) END FROM (
        SELECT g, p, g * (kk/1e6 - 2*p*k + p*p*n) / ((g-1)*n) AS s2, p*(1-p)*(inv/1e6)/g AS w FROM (
        SELECT count(*)::DOUBLE g, sum(n)::DOUBLE n, sum(k)::DOUBLE k, sum(floor(k*k*1000000/n))::DOUBLE kk, sum(floor(1000000/n))::DOUBLE inv, (SELECT p FROM total) p FROM {src} WHERE n > 0)))"""


ORACLE = rf"""
WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
bad AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
outcomes AS (SELECT host, bad FROM seen LEFT JOIN bad ON try_cast(regexp_extract(path, '^(?:.*[^0-9])?([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) = doc_id),
hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM outcomes GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
total AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 1.0) / (sum(n) + 2.0) ELSE 0.0 END::DOUBLE AS p FROM suffixes),
m AS (SELECT {_strength_sql('suffixes')} AS ms, {_strength_sql('domains')} AS md, {_strength_sql('hosts')} AS mh),
ps AS (SELECT suffix, (k + ms * (SELECT p FROM total)) / (n + ms) AS p FROM suffixes, m),
pd AS (SELECT domain, (k + md * ps.p) / (n + md) AS p FROM domains JOIN ps USING (suffix), m),
post AS (SELECT host, k + mh * pd.p AS a, n - k + mh * (1 - pd.p) AS b FROM hosts JOIN pd USING (domain), m),
over AS (SELECT host FROM post WHERE a/(a+b) - 1.645 * sqrt(a/(a+b) * (1 - a/(a+b)) / (a+b+1)) > 0.5),
rules(verdict, h, p) AS (VALUES ('block','net','/'), ('allow','example.net','/en/'), ('block','example.com','/de/'), ('allow','org','/fr/')),
hit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM seen JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT s.page_id, s.host, s.path, hit.rule, coalesce(hit.verdict, CASE WHEN over.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM seen s LEFT JOIN hit USING (page_id) LEFT JOIN over ON s.host = over.host
"""
