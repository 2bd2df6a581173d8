"""URL filter by Empirical-Bayes host reputation, with explicit allow and block rules on top.

Labelled page outcomes (good or bad) are counted by host. Beta-binomial priors shrink them:
the overall rate is the prior mean of a suffix, a suffix's posterior mean that of its registered
domains, a domain's that of its hosts. How strongly each level shrinks is estimated from the data
by the method of moments. A host whose posterior lower bound of the bad rate is above the
threshold is blocked. Everything is DataFrame expressions: one equi-join for the labels, one
aggregation by host, and small aggregations and joins on what that leaves.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by
the reputation of the empty host. Null labels count as unlabelled; of repeated labels for a page
the worst counts. Repeated pages are judged and counted each time. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower

#: (verdict, host, path) of the production rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
Z, THRESHOLD = 1.645, 0.5
#: Limits of the estimated within-group correlation; strength of a prior is 1 / rho - 1.
RHO = (0.001, 0.5)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(raw), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)


def domain_and_suffix(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    two = F.substring_index(host, ".", -2)
    wide = two.isin(list(two_label))
    return F.when(wide, F.substring_index(host, ".", -3)).otherwise(two), F.when(wide, two).otherwise(F.substring_index(host, ".", -1))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule = verdict = None
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def _strength(groups: DataFrame) -> DataFrame:
    """One row (kappa, mean): a level's prior strength by the method of moments, from rows (n, k)."""
    seen = groups.filter(F.col("n") > 0)
    s = seen.agg(
        F.count(F.lit(1)).alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("w"), F.coalesce(F.sum("k"), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(F.col("k") * F.col("k") / F.col("n").cast("double")), F.lit(0.0)).alias("kk"),
    )
    m = (F.col("bad") + 1.0) / (F.col("w") + 2.0)
    spread = F.col("kk") - F.col("bad") * (F.col("bad") / F.greatest(F.col("w"), F.lit(1)).cast("double"))
    rho = F.when(F.col("w") > F.col("g"), (spread / (m * (1.0 - m)) - F.col("g")) / (F.col("w") - F.col("g"))).otherwise(F.lit(RHO[0]))
    return s.select(m.alias("mean"), F.round(1.0 / F.greatest(F.lit(RHO[0]), F.least(F.lit(RHO[1]), rho)) - 1.0, 6).alias("kappa"))


def reputations(hosts: DataFrame, z: float = Z) -> DataFrame:
    """Rows (host, n, k) in; (host, n, k, bad_rate, bad_bound) out."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # three one-row tables
    at_suffix, at_domain, at_host = (F.broadcast(_strength(x).select(F.col("mean").alias(f"mean_{i}"), F.col("kappa").alias(f"kappa_{i}"))) for i, x in enumerate((suffixes, domains, hosts)))
    mu_s = suffixes.join(at_suffix).select("suffix", ((F.col("kappa_0") * F.col("mean_0") + F.col("k")) / (F.col("kappa_0") + F.col("n"))).alias("mu_s"))
    mu_d = domains.join(mu_s, "suffix").join(at_domain).select("domain", ((F.col("kappa_1") * F.col("mu_s") + F.col("k")) / (F.col("kappa_1") + F.col("n"))).alias("mu_d"))
    a, b = F.col("kappa_2") * F.col("mu_d") + F.col("k"), F.col("kappa_2") * (1.0 - F.col("mu_d")) + (F.col("n") - F.col("k"))
    rate = a / (a + b)
    return hosts.join(mu_d, "domain").join(at_host).select("host", "n", "k", rate.alias("bad_rate"), (rate - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0)))).alias("bad_bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_labelled, bad_rate.

    pages: page_id, url. labels: doc_id (the page's id), quality, toxic; a page is bad if its
    quality is 0 or it is toxic.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    counted = pages.select("page_id", "host").join(outcomes, pages["page_id"] == outcomes["doc_id"], "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    known = reputations(counted, z)
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")
    return pages.join(known, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), F.col("n").alias("n_labelled"), F.round("bad_rate", 6).alias("bad_rate"))


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, z: float = Z) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in ordered]
    rule = " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    says = " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))
    wide = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    last = lambda n: f"array_to_string(list_slice(string_split(host, '.'), -{n}, -1), '.')"
    level = lambda t: f"""SELECT (bad + 1.0::DOUBLE) / (w + 2.0::DOUBLE) AS mean, round(1.0::DOUBLE / greatest({RHO[0]}::DOUBLE, least({RHO[1]}::DOUBLE, CASE WHEN w > g THEN
        ((kk - bad * (bad / greatest(w, 1)::DOUBLE)) / (((bad + 1.0::DOUBLE) / (w + 2.0::DOUBLE)) * (1.0::DOUBLE - (bad + 1.0::DOUBLE) / (w + 2.0::DOUBLE))) - g) / (w - g) ELSE {RHO[0]}::DOUBLE END)) - 1.0::DOUBLE, 6) AS kappa
        FROM (SELECT count(*)::BIGINT AS g, coalesce(sum(n), 0)::BIGINT AS w, coalesce(sum(k), 0)::BIGINT AS bad, coalesce(sum(k * k / n::DOUBLE), 0.0::DOUBLE) AS kk FROM {t} WHERE n > 0)"""  # noqa: E731
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0) AS raw FROM cut),
    p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM parts),
    o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
    h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM p LEFT JOIN o ON p.page_id = o.doc_id GROUP BY host),
    h AS (SELECT *, CASE WHEN {last(2)} IN ({wide}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {last(2)} IN ({wide}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM h0),
    d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM h GROUP BY ALL),
    s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM d GROUP BY ALL),
    ls AS ({level('s')}), ld AS ({level('d')}), lh AS ({level('h')}),
    ms AS (SELECT suffix, (kappa * mean + k) / (kappa + n) AS mu_s FROM s, ls),
    md AS (SELECT domain, (kappa * mu_s + k) / (kappa + n) AS mu_d FROM d JOIN ms USING (suffix), ld),
    ab AS (SELECT host, n, kappa * mu_d + k AS a, kappa * (1.0::DOUBLE - mu_d) + (n - k) AS b FROM h JOIN md USING (domain), lh),
    r AS (SELECT host, n, a / (a + b) AS rate, a / (a + b) - {z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0::DOUBLE))) AS bound FROM ab)
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {says} WHEN bound > {threshold}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict,
        n AS n_labelled, round(rate, 6) AS bad_rate FROM p JOIN r USING (host)"""
