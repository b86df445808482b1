"""URL filters: longest-match rules, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes are counted by host, registered domain and suffix. Each level is a beta-binomial: a level's rate
of bad pages is shrunk towards the level above (host to registered domain to suffix to all), with a strength fitted by
moments from how far the rates of one level spread. A page without a rule is blocked if the lower posterior bound of
its host's rate of bad pages passes the threshold.

Defined results: a null url or one without `://` has an empty host and path; hosts without labelled pages take the
shrunk rate of their domain; labels that repeat count once, the worst of them; pages that repeat give a row each, and each
counts its label; extra columns are not read, so they cannot clash; empty tables give no rows or no labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import ascii_lower, written

#: Second-level names under which two-letter country suffixes register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
PORT, ADDRESS = r":[0-9]*$", r"^[0-9]+(\.[0-9]+){3}$"
DEFAULT_STRENGTH = 10.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?`, `#`; A-Z lower-cased) and path (then up to `?` or `#`)."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule. rules: (allow or block, host + path prefix), a short list from the configuration."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    """The host without its port: an address of numbers whole, else its last two labels, or three below a second-level name."""
    bare = F.regexp_replace(host, PORT, "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    deep = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*second_level)
    return F.when((n <= 2) | bare.rlike(ADDRESS), bare).otherwise(F.array_join(F.slice(labels, F.when(deep, -3).otherwise(-2), F.when(deep, 3).otherwise(2)), "."))


def suffix(domain: Column) -> Column:
    return F.when((F.instr(domain, ".") > 0) & ~domain.rlike(ADDRESS), F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def _strength(level: DataFrame) -> list[Column]:
    """Aggregates for the moments of a level with columns n (labelled) and bad."""
    p = F.col("bad") / F.col("n")
    return [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * p * p).alias("np2"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2")]


def fit_strength(n: float, bad: float, np2: float, k: int, n2: float) -> float:
    """Prior strength (a + b) of a beta-binomial by moments; the default where rates do not spread or cannot tell."""
    if not k or k < 2 or not n:
        return DEFAULT_STRENGTH
    m = bad / n
    within = m * (1 - m)
    spread = np2 - n * m * m
    between = (spread - (k - 1) * within) / max(n - n2 / n, 1e-9)
    if within <= 0 or between <= 0:
        return 1000.0 if within > 0 else DEFAULT_STRENGTH
    return min(1000.0, max(1.0, within / between - 1))


def host_reputation(counts: DataFrame, z: float = 1.6448536269514722, second_level: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """(host, rate, low): shrunk rate of bad pages and its lower bound. counts: (host, n, bad), a row for each host, n may be 0.

    Three sets of five sums come to the driver; all else stays distributed.
    """
    levels = counts.withColumn("domain", registered_domain(F.col("host"), second_level)).withColumn("suffix", suffix(F.col("domain")))
    domains = levels.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    fitted = []
    for level in (levels, domains, suffixes):
        row = level.where("n > 0").agg(*_strength(level)).first()
        fitted.append((row, fit_strength(float(row.n or 0), float(row.bad or 0), float(row.np2 or 0), row.k, float(row.n2 or 0))))
    total = fitted[0][0]
    rate = (float(total.bad or 0) + 1) / (float(total.n or 0) + 2)
    s_host, s_domain, s_suffix = (s for _, s in fitted)
    shrunk = lambda prior, s: (F.lit(s) * prior + F.col("bad")) / (F.lit(s) + F.col("n"))
    suffixes = suffixes.select("suffix", shrunk(F.lit(rate), s_suffix).alias("ps"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("ps"), s_domain).alias("pd"))
    a = F.lit(s_host) * F.col("pd") + F.col("bad")
    total_ab = F.lit(s_host) + F.col("n")
    mean = a / total_ab
    return levels.join(domains, "domain").select("host", mean.alias("rate"), (mean - z * F.sqrt(mean * (1 - mean) / (total_ab + 1))).alias("low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame | None, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", block_above: float = 0.5, second_level: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_low). outcomes: (page, bad boolean) of labelled pages, page being a value of id_col."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = url_parts(F.col("url"))
    parts = src.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    known = parts.select("page_id", "host", F.lit(None).cast("boolean").alias("bad"))
    if outcomes is not None:
        worst = outcomes.select(F.col("page"), F.col("bad").cast("boolean").alias("bad")).where("page IS NOT NULL AND bad IS NOT NULL").groupBy("page").agg(F.max("bad").alias("bad"))
        known = known.drop("bad").join(worst, known.page_id == worst.page, "left").select("page_id", "host", "bad")
    # a row for each host, written once: the three fits and the join below read it
    counts, _ = written(known.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")), "hosts")
    reputation = host_reputation(counts, second_level=second_level)
    judged = parts.join(reputation, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("low") > block_above, "block").otherwise("allow")).alias("verdict"), F.col("rate").alias("bad_rate"), F.col("low").alias("bad_low"))
