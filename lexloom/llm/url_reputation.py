"""URL filters: fixed rules first, then an empirical-Bayes reputation of hosts.

Labelled pages count as good or bad.  A host's share of bad pages is shrunk towards that of its registered domain,
the domain's towards that of its suffix, the suffix's towards the whole, each by a beta prior whose strength comes
from the spread of the level's own units (method of moments: excess of squared deviations over binomial variance).
A url without a rule is blocked where the lower posterior bound of its host's share of bad pages is above a limit:
only hosts that are surely bad go.  Hosts without labelled pages take their domain's posterior mean.

host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the
end.  A null url or one without "://" has both empty, fits no rule and is judged as a host of its own.  The
registered domain is the last two labels, the suffix the last one.  Repeated pages count as often as they occur;
repeated labels of one key count once (bad if any of them is); null labels are no labels.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import cut

#: Fixed rules: (verdict, host, path prefix).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LEVELS = ("suffix", "domain", "host")
#: Standard deviations of the bound, the limit, and the bounds of the correlation inside a unit.
Z, LIMIT, RHO = 1.645, 0.5, (0.001, 0.5)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of two as long, the blocking one; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def reputation(pages: DataFrame, z: float = Z, rho: tuple = RHO) -> DataFrame:
    """host, bad_mean, bad_low, a row a host.  pages: host, and bad (0 or 1, null: not labelled)."""
    units = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    units = units.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})
    units = cut(units)  # a row a host, read by every level
    # the whole: a uniform prior, so that its mean is never 0 or 1
    above = units.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mu"))
    own = None
    for level, parent in zip(LEVELS, (None, *LEVELS), strict=False):
        own = units.groupBy(*{level: 0, **({parent: 0} if parent else {})}).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        own = own.join(above, parent) if parent else own.join(F.broadcast(above))  # above is one row here
        v = F.col("n") * F.col("mu") * (1 - F.col("mu"))
        spread = own.agg(
            ((F.sum(F.pow(F.col("b") - F.col("n") * F.col("mu"), 2)) - F.sum(v)) / F.nullif(F.sum(v * (F.col("n") - 1)), F.lit(0.0))).alias("rho")
        ).select((1 / F.least(F.greatest(F.coalesce("rho", F.lit(0.0)), F.lit(rho[0])), F.lit(rho[1])) - 1).alias("k"))
        own = own.join(F.broadcast(spread)).withColumn("mean", (F.col("b") + F.col("k") * F.col("mu")) / (F.col("n") + F.col("k")))
        own = cut(own)
        above = own.select(level, F.col("mean").alias("mu"))
    low = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("k") + 1))
    return own.select("host", F.col("mean").alias("bad_mean"), low.alias("bad_low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, key: str = "page_id", rules=RULES, limit: float = LIMIT) -> DataFrame:
    """key, host, path, rule, verdict.  pages: key, url, label_key; outcomes: label_key, bad."""
    url = F.col("url")
    rows = pages.select(key, "label_key", host_of(url).alias("host"), path_of(url).alias("path"))
    once = outcomes.groupBy("label_key").agg(F.max("bad").alias("bad"))
    known = reputation(rows.join(once, "label_key", "left").select("host", "bad"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_low") > limit, "block").otherwise("allow")
    return rows.join(known, "host", "left").select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def label_key_of(url: Column) -> Column:
    """Number of the document that a page of the synthetic tables shows: the digits after the path's language."""
    return F.expr("try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') AS bigint)")


def bad_outcomes(labels: DataFrame) -> DataFrame:
    bad = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("long"))
    return labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_key"), bad.alias("bad"))


def _level_sql(level: str, parent: str | None, above: str) -> str:
    joined = f"u JOIN {above} a USING ({parent})" if parent else f"u CROSS JOIN {above} a"
    keys = level + (f", {parent}" if parent else "")
    return f"""
u_{level} AS (SELECT {keys}, sum(n) AS n, sum(b) AS b FROM units GROUP BY {keys}),
m_{level} AS (SELECT u.*, mu FROM u_{level} {joined}),
k_{level} AS (SELECT 1 / least(greatest(coalesce((sum(power(b - n * mu, 2)) - sum(n * mu * (1 - mu))) / nullif(sum(n * mu * (1 - mu) * (n - 1)), 0), 0.0), {RHO[0]}), {RHO[1]}) - 1 AS k FROM m_{level}),
p_{level} AS (SELECT {level}, n, k, (b + k * mu) / (n + k) AS mu FROM m_{level} CROSS JOIN k_{level})"""


def _rule_sql(what: int) -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, kind)[what]}'" for kind, h, p in rules) + " END"


ORACLE = f"""
WITH rows AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') AS bigint) AS label_key FROM pages),
once AS (SELECT doc_id AS label_key, max(CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
units AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS b
  FROM rows LEFT JOIN once USING (label_key) GROUP BY 1, 2, 3),
p_whole AS (SELECT (coalesce(sum(b), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mu FROM units),
{_level_sql("suffix", None, "p_whole")},
{_level_sql("domain", "suffix", "(SELECT suffix, mu FROM p_suffix)")},
{_level_sql("host", "domain", "(SELECT domain, mu FROM p_domain)")}
SELECT page_id, host, path, {_rule_sql(0)} AS rule,
  coalesce({_rule_sql(1)}, CASE WHEN mu - {Z} * sqrt(mu * (1 - mu) / (n + k + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM rows LEFT JOIN p_host USING (host)
"""
