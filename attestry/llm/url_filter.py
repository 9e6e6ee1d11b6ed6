"""URL filter: rules by host and path, and empirical-Bayes reputation where no rule fits.

Labelled page outcomes are counted per host. The rate of bad pages is shrunk in three steps: a suffix towards
the overall rate, a registered domain towards its suffix, a host towards its registered domain. Each step's
beta prior has its parent's rate as mean; its strength comes from the groups' spread around their parents (the
intra-class correlation of the beta-binomial, by moments). A host is blocked when the lower bound of its
posterior rate is above ``max_bad``.

Defined results: null urls and urls without ``://`` have empty host and path and are judged as the host ''.
Hosts without a label follow their parents. Repeated pages are judged one by one; a page labelled twice is bad
if any label says so. Without any label no host is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import checkpointed, join_on_hot_key

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Standard deviations of the bound, and the rate it may not exceed.
Z, MAX_BAD = 1.64, 0.3
#: Bounds on the correlation, so that a prior weighs from 1 to 999 pages.
LEAST_RHO, MOST_RHO = 0.001, 0.5
# Second-level labels under which names are registered one level deeper.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return (
        F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    name, verdict = None, None
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        of_host, _, rest = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + rest)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def domain_and_suffix(host: str) -> tuple[Column, Column]:
    """Registered domain and suffix; an address of numbers is its own domain."""
    labels = F.split(F.col(host), r"\.")
    two = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2)
    two = two & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    numeric = F.col(host).rlike(r"^[0-9.:\[\]]+$")
    suffix = F.when(numeric, "").when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    domain = (
        F.when(numeric, F.col(host)).when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    )
    return domain, suffix


def _strength(groups: DataFrame) -> float:
    """Prior pages of a level, from groups (n, bad, parent rate)."""
    n, p, mean = F.col("n"), F.col("bad") / F.col("n"), F.col("parent")
    row = (
        groups.filter("n > 0")
        .agg(F.sum(n), F.count("*"), F.sum(n * (p - mean) * (p - mean)), F.sum(n * mean * (1 - mean)))
        .first()
    )
    total, count, spread, noise = row[0] or 0, row[1], row[2] or 0.0, row[3] or 0.0
    rho = LEAST_RHO if total <= count or noise <= 0 else (spread / noise - count / total) / (1 - count / total)
    return 1.0 / min(max(rho, LEAST_RHO), MOST_RHO) - 1.0


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, pages, n, bad, rate, lower) of every host of ``pages`` (page_id, host).

    ``outcomes`` are (page_id, bad) with one row per page. Counts combine per task before each shuffle.
    """
    joined = pages.join(outcomes, "page_id", "left")
    hosts = joined.groupBy("host").agg(
        F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    domain, suffix = domain_and_suffix("host")
    hosts = checkpointed(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    n, bad = hosts.agg(*sums).first()
    overall = ((bad or 0) + 1.0) / ((n or 0) + 2.0)

    def shrunk(groups: DataFrame) -> DataFrame:
        k = _strength(groups)
        return groups.withColumn("weight", F.col("n") + k).withColumn("rate", (F.col("bad") + k * F.col("parent")) / F.col("weight"))

    suffixes = checkpointed(shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("parent", F.lit(overall))))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", F.col("rate").alias("parent")), "suffix")
    domains = checkpointed(shrunk(domains))
    named = hosts.join(domains.select("domain", "suffix", F.col("rate").alias("parent")), ["domain", "suffix"])
    lower = F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return shrunk(named).select("host", "pages", "n", "bad", "rate", lower.alias("lower"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """A page is bad if it is of low quality or toxic; labels of both kinds null say nothing."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_bad: float = MAX_BAD
) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url)."""
    host, path = host_and_path("url")
    parsed = checkpointed(pages.select("page_id", host.alias("host"), path.alias("path")))
    hosts = checkpointed(host_reputation(parsed.select("page_id", "host"), outcomes))
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    by_rate = F.when((F.col("n_all") > 0) & (F.col("lower") > max_bad), "block").otherwise("allow")
    labelled = hosts.agg(F.sum("n")).first()[0] or 0
    joined = join_on_hot_key(parsed, hosts.withColumn("n_all", F.lit(labelled)), "host", "pages", total)
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_rate).alias("verdict"))
