"""Host reputation: labelled page outcomes shrunk from suffix to registered domain to host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkburst.llm.common import join_checked, stored, without

#: (verdict, host, path): a rule holds for its host and all hosts below it, where the url's path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Second-level labels under two-letter suffixes that are suffixes themselves.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: A host is blocked if its bad rate lies above this with about 95 % posterior probability.
MAX_BAD, Z = 0.5, 1.645
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; the rules are a short list given by the caller."""
    rule = verdict = None
    for say, at, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = (F.when(fits, at + start), F.when(fits, say)) if rule is None else (rule.when(fits, at + start), verdict.when(fits, say))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def suffix_of(host: Column) -> Column:
    parts = F.split(host, r"\.")
    two = (F.size(parts) >= 3) & (F.char_length(F.element_at(parts, -1)) == 2) & F.element_at(parts, F.when(F.size(parts) >= 2, -2).otherwise(-1)).isin(*SECOND_LEVEL)
    return F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(labels == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength (pseudo pages) of a beta-binomial by moments: what counts spread over binomial spread."""
    m = F.col(mean)
    row = groups.where("n > 0").agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * m, 2) - F.col("n") * m * (1 - m)), F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m))
    ).first()
    rho = min(max((row[0] or 0.0) / row[1], 0.001), 0.5) if row[1] else 0.5
    return round(1 / rho - 1, 6)


def host_reputation(pages: DataFrame) -> DataFrame:
    """(host, n, bad, alpha, beta, floor) for every host of pages (host, bad: 1, 0 or null where unlabelled).

    Outcomes are counted by host (partial sums first, so a hot host is cheap), then by registered domain and suffix.
    Each level's mean is its counts shrunk to the mean above it, with a strength fitted to that level's spread; the
    host's posterior is a beta, and floor is its mean less Z standard deviations.
    """
    host = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    host = host.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    host = stored(host)
    domain = host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffix.agg(F.sum("n"), F.sum("bad")).first()
    mean = ((total[1] or 0) + 1.0) / ((total[0] or 0) + 2.0)

    def shrunk(groups: DataFrame, above: str, name: str, keys: list[str]) -> DataFrame:
        k = _strength(groups, above)
        return stored(groups.select(*keys, ((F.col("bad") + k * F.col(above)) / (F.col("n") + k)).alias(name)))

    suffix = shrunk(suffix.withColumn("m0", F.lit(mean)), "m0", "m1", ["suffix"])
    domain = shrunk(join_checked(domain, suffix, ["suffix"], "inner"), "m1", "m2", ["suffix", "domain"])
    host = join_checked(host, domain, ["suffix", "domain"], "inner")
    k = _strength(host, "m2")
    host = host.withColumns({"alpha": F.col("bad") + k * F.col("m2"), "beta": F.col("n") - F.col("bad") + k * (1 - F.col("m2"))})
    spread = F.sqrt(F.col("alpha") * F.col("beta") / (F.pow(F.col("alpha") + F.col("beta"), 2) * (F.col("alpha") + F.col("beta") + 1)))
    return host.withColumn("floor", F.col("alpha") / (F.col("alpha") + F.col("beta")) - Z * spread).select("host", "n", "bad", "alpha", "beta", "floor")


def judge_urls(pages: DataFrame, outcomes: DataFrame, page: str = "page_id", url: str = "url", rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """pages with host, path, rule and verdict: the longest fitting rule decides, else the host's posterior bound.

    outcomes has (page, bad); of several outcomes of a page the worst counts. A url that is null or has no :// has an
    empty host and path, fits no rule and is judged as the host ''. Hosts without labelled pages stand at the mean of
    their domain or suffix. The last join splits a hot host's pages (adaptive skew join); all that is broadcast is
    checked to be small. Columns of pages with an output's name are replaced. An empty table gives no rows.
    """
    names = without(pages, "host", "path", "rule", "verdict")
    rows = pages.select(*names, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    worst = outcomes.where(F.col(page).isNotNull()).groupBy(F.col(page).alias("__page")).agg(F.max("bad").alias("bad"))
    known = host_reputation(rows.select(F.col(page).alias("__page"), "host").join(worst, "__page", "left").select("host", "bad"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = known.select(F.col("host").alias("__host"), (F.col("floor") > max_bad).alias("__blocked"))
    out = rows.join(judged, F.col("host") == F.col("__host"), "left")
    return out.select(*names, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("__blocked"), "block").otherwise("allow")).alias("verdict"))


def url_report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's outcome is the quality label of the document of the same id: 0 is bad."""
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge_urls(pages.select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict")
