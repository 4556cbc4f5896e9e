"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host. A host's rate of bad pages is shrunk
towards its registered domain's, that towards its suffix's, and that towards the
rate of all. Each level's prior is a beta distribution around the parent's mean
whose strength is estimated from the level's own groups by moments of the
beta-binomial: E[n (x/n - m)^2] = m (1 - m) (1 + (n - 1) rho), strength 1/rho - 1.
A host is blocked if even the lower posterior bound of its rate is above the limit.

DataFrame functions only. Only ids, hosts and 0/1 outcomes are shuffled; counts
are summed map-side, so a host with a third of all pages costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, checkpointed

#: (host/path, verdict); the longest that fits wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Second-level labels that are part of a suffix below a two-letter top label (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: A host is blocked if its rate of bad pages is above MAX_BAD at Z standard deviations below the posterior mean.
MAX_BAD, Z = 0.5, 1.645
#: Bounds of the estimated intra-group correlation.
RHO = (0.0001, 0.99)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _plain(host: Column) -> Column:
    """Host without user, port and final dot, for reputation only."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.?(:[0-9]*)?$", "")


def suffix_of(host: Column) -> Column:
    labels = F.split(_plain(host), r"\.")
    last, second, n = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2)), F.size(labels)
    two = (n >= 3) & (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    return F.when((n <= 1) | last.rlike("^[0-9]*$"), F.lit("")).when(two, F.concat_ws(".", second, last)).otherwise(last)


def registered_domain_of(host: Column) -> Column:
    labels, suffix = F.split(_plain(host), r"\."), suffix_of(host)
    keep = F.size(F.split(suffix, r"\.")) + 1
    return F.when(suffix == "", _plain(host)).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - keep + 1, F.lit(1)), keep), "."))


def _fits(host: Column, path: Column, rule: str) -> Column:
    rule_host, slash, rest = rule.partition("/")
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)


def _longest(host: Column, path: Column, rules: tuple, what: int) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        out = F.when(_fits(host, path, rule[0]), F.lit(rule[what])).otherwise(out)
    return out


def _strength(level: DataFrame) -> float:
    """Of the prior of ``level(n, x, m)``: how many pages the parent's mean counts for."""
    spread = F.sum(F.expr("n * (x / n - m) * (x / n - m) - m * (1 - m)"))
    within = F.sum(F.expr("m * (1 - m) * (n - 1)"))
    rho = level.filter("n > 0").agg(F.when(within > 0, spread / within)).first()[0]
    rho = min(max(rho if rho is not None else RHO[0], RHO[0]), RHO[1])
    return 1 / rho - 1


def _level(groups: DataFrame, key: str, up: DataFrame, parent: str) -> tuple[DataFrame, float]:
    """``groups(key, parent, n, x)`` with the parent's mean m and the strength of the prior."""
    level = groups.join(up, parent, "left").select(key, parent, "n", "x", "m")
    return level, _strength(level)


def host_posteriors(outcomes: DataFrame) -> DataFrame:
    """``outcomes(host, bad)``, bad 0, 1 or null, to one row per host: n, x, mean, sd of the rate of bad pages.

    Hosts without a labelled page get the prior that their domain gives. With no
    label at all every mean is 1/2.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    hosts = hosts.select("host", registered_domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "x")
    hosts = checkpointed(hosts)
    total = hosts.agg(F.sum("n"), F.sum("x")).first()
    mean = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    sums = [F.sum("n").alias("n"), F.sum("x").alias("x")]
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("m", F.lit(mean))
    k = _strength(suffixes)
    up = suffixes.select("suffix", ((F.col("x") + k * F.col("m")) / (F.col("n") + k)).alias("m"))
    domains, k = _level(hosts.groupBy("domain", "suffix").agg(*sums), "domain", up, "suffix")
    up = domains.select("domain", "suffix", ((F.col("x") + k * F.col("m")) / (F.col("n") + k)).alias("m"))
    level = hosts.join(up, ["domain", "suffix"], "left").select("host", "n", "x", "m")
    k = _strength(level)
    a, b = F.col("x") + k * F.col("m"), F.col("n") - F.col("x") + k * (1 - F.col("m"))
    level = level.select("host", "n", "x", a.alias("a"), b.alias("b"))
    return level.select("host", "n", "x", F.expr("a / (a + b)").alias("mean"), F.expr("sqrt(a * b / (a + b + 1)) / (a + b)").alias("sd"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """Judge every row of ``pages(page_id, url)``: page_id, host, path, rule, verdict.

    ``labels(doc_id, quality, toxic)`` names pages by id; a page is bad if any of
    its labels has quality 0 or toxic 1, unlabelled if they say neither. A null
    url, or one without ``://``, has an empty host and path and is judged as the
    host "". Repeated rows and null ids stay, each judged by its url.
    """
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
    known = known.groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    outcomes = judged.join(known, judged["page_id"] == known["doc_id"], "left").select("host", "bad")
    reputation = host_posteriors(outcomes).select(F.col("host").alias("_host"), (F.col("mean") - z * F.col("sd") > max_bad).alias("_bad"))
    out = judged.join(reputation, judged["host"] == reputation["_host"], "left")
    rule, by_rule = _longest(F.col("host"), F.col("path"), rules, 0), _longest(F.col("host"), F.col("path"), rules, 1)
    by_method = F.when(F.coalesce(F.col("_bad"), F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, by_method).alias("verdict"))


def _sql() -> str:
    fits = {r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')" for r, _ in RULES}
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = " ".join(f"WHEN {fits[r]} THEN '{r}'" for r, _ in ordered)
    verdict = " ".join(f"WHEN {fits[r]} THEN '{v}'" for r, v in ordered)
    second = ", ".join(f"'{s}'" for s in SECOND_LEVEL)
    strength = f"(SELECT 1 / least(greatest(coalesce(sum(n * (x / n - m) * (x / n - m) - m * (1 - m)) / nullif(sum(m * (1 - m) * (n - 1)), 0), {RHO[0]}), {RHO[0]}), {RHO[1]}) - 1 AS k FROM {{}} WHERE n > 0)"
    az, za = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH judged AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{az}', '{za}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
known AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality = 0, false) OR coalesce(toxic = 1, false) THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
counted AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS x
  FROM judged LEFT JOIN known ON page_id = doc_id GROUP BY host),
plain AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\\.?(:[0-9]*)?$', ''), '.') AS parts FROM counted),
cut AS (
  SELECT *, CASE WHEN len(parts) <= 1 OR regexp_full_match(parts[-1], '[0-9]*') THEN 0
                 WHEN len(parts) >= 3 AND length(parts[-1]) = 2 AND parts[-2] IN ({second}) THEN 2 ELSE 1 END AS s
  FROM plain),
hosts AS (
  SELECT host, n, x, CASE WHEN s = 0 THEN '' ELSE array_to_string(parts[-s:], '.') END AS suffix,
         CASE WHEN s = 0 THEN array_to_string(parts, '.') ELSE array_to_string(parts[-(s + 1):], '.') END AS domain
  FROM cut),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT (coalesce(sum(x), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM hosts) AS m
  FROM hosts GROUP BY suffix),
suffix_means AS (SELECT suffix, (x + k * m) / (n + k) AS m FROM suffixes, {strength.format("suffixes")}),
domains AS (
  SELECT d.*, m FROM (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY domain, suffix) d JOIN suffix_means USING (suffix)),
domain_means AS (SELECT domain, suffix, (x + k * m) / (n + k) AS m FROM domains, {strength.format("domains")}),
level AS (SELECT host, n, x, m FROM hosts JOIN domain_means USING (domain, suffix)),
beta AS (SELECT host, x + k * m AS a, n - x + k * (1 - m) AS b FROM level, {strength.format("level")})
SELECT page_id, host, path, CASE {rule} END AS rule,
       coalesce(CASE {verdict} END,
                CASE WHEN a / (a + b) - {Z} * sqrt(a * b / (a + b + 1)) / (a + b) > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged JOIN beta USING (host)"""


SQL = _sql()
