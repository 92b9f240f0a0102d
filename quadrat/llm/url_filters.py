"""URL filters: fixed host/path rules, then empirical-Bayes host reputation.

Labelled page outcomes are counted by host and shrunk through beta-binomial priors: the suffix's rate
towards the overall rate, the registered domain's towards its suffix's, the host's towards its domain's.
The prior's weight (in pages) is estimated from the hosts by the analysis-of-variance estimator of the
intra-host correlation. A host is blocked where even the lower posterior bound of its rate of bad pages
is above the threshold.

The registered domain is the public suffix (quadrat.llm.suffixes: rules, wildcards, exceptions; other rules may be given)
and the label before it. User, port and a last dot do not count; an address is a domain of its own, and all addresses share
one suffix; a host that is a suffix itself is its own domain.

Defined cases: a null URL or one without "://" has an empty host and path and is allowed unless a rule
fits; pages without an outcome count for nothing; a null outcome is no outcome, and a null id has none; several
outcomes of one page all count; repeated pages are judged alike and all kept; of rules that fit, the longest counts (no
two are equally long); very long URLs are judged whole; an empty table gives an empty result.
Only the id and URL columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import ascii_lower
from quadrat.llm.suffixes import RULES as SUFFIXES
from quadrat.llm.suffixes import labels_of_suffix

#: Fixed values: (verdict, host and path prefix) of the contract.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
HEAD = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, HEAD, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, HEAD, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for does, text in sorted(rules, key=lambda r: len(r[1])):
        name, start = text.split("/", 1)
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(does)).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """The host without user, port and the root's dot."""
    return F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$|\.+$|\.+(?=:[0-9]*$)", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$")


def _last(host: Column, more: int, address: Column, suffixes: Iterable[str]) -> Column:
    name = name_of(host)
    labels, most = labels_of_suffix(name, suffixes)
    out = F.when(is_address(name), address)
    for k in range(most, 1, -1):
        out = out.when(labels == k, F.substring_index(name, ".", -k - more))
    return out.otherwise(F.substring_index(name, ".", -1 - more))


def suffix_of(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """What domains are registered under; all addresses have the empty one."""
    return _last(host, 0, F.lit(""), suffixes)


def domain_of(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """The suffix and the label before it; an address is a domain of its own."""
    return _last(host, 1, name_of(host), suffixes)


def reputation(hosts: DataFrame, z: float = 1.645, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """hosts: host, n (labelled pages), bad. Adds the posterior mean and its lower bound (mean - z sd).

    One row per host stays one row; everything above hosts is an aggregate of aggregates.
    """
    hosts = hosts.select("host", "n", "bad", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"))
    n, r = F.col("n").cast("double"), F.col("bad") / F.greatest(F.col("n"), F.lit(1))
    # sums over hosts for the analysis of variance; between = sum n (r - p)^2 = sum n r^2 - N p^2
    s = hosts.filter("n > 0").agg(
        F.count("*").cast("double").alias("m"),
        F.coalesce(F.sum(n), F.lit(0.0)).alias("N"),
        F.coalesce(F.sum(n * n), F.lit(0.0)).alias("N2"),
        F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("B"),
        F.coalesce(F.sum(n * r * r), F.lit(0.0)).alias("R2"),
    )
    p = F.when(F.col("N") > 0, F.col("B") / F.greatest("N", F.lit(1.0))).otherwise(0.5)
    between = F.greatest(F.col("R2") - F.col("N") * p * p, F.lit(0.0)) / F.greatest(F.col("m") - 1, F.lit(1.0))
    within = F.greatest(F.col("B") - F.col("R2"), F.lit(0.0)) / F.greatest(F.col("N") - F.col("m"), F.lit(1.0))
    n0 = (F.col("N") - F.col("N2") / F.greatest("N", F.lit(1.0))) / F.greatest(F.col("m") - 1, F.lit(1.0))
    rho = (between - within) / F.greatest(between + (n0 - 1) * within, F.lit(1e-9))
    k = F.lit(1.0) / F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.5)) - 1
    prior = s.select(p.alias("p0"), k.alias("k"))
    p0, k = (F.lit(0) + prior.select(c).scalar() for c in ("p0", "k"))

    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).select("suffix", ((F.col("bad") + k * p0) / (F.col("n") + k)).alias("p_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("bad") + k * F.col("p_suffix")) / (F.col("n") + k)).alias("p_domain"))
    a, b = F.col("bad") + k * F.col("p_domain"), F.col("n") - F.col("bad") + k * (1 - F.col("p_domain"))
    out = hosts.join(domains, "domain").withColumns({"a": a, "b": b})
    ab, mean = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    return out.select("host", "n", "bad", mean.alias("mean"), (mean - z * F.sqrt(F.col("a") * F.col("b") / (ab * ab * (ab + 1)))).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, *, page_id: str = "page_id", url: str = "url", outcome_id: str = "page_id", bad: str = "bad", rules=RULES, suffixes: Iterable[str] = SUFFIXES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. outcomes: an id and 1 (bad) or 0.

    The page side of the last join keeps its order of magnitude: it meets blocked hosts only, and a
    hot host's pages can be split by the engine since the other side has one row per host.
    """
    u = F.col(url)
    seen = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    # outcomes are summed per id first: ids are unique after that, and no page row is repeated
    told = outcomes.filter(F.col(bad).isNotNull()).groupBy(F.col(outcome_id).alias("page_id")).agg(F.count("*").alias("n"), F.sum(F.col(bad).cast("long")).alias("bad"))
    counts = seen.select("page_id", "host").join(told, "page_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # a host without outcomes has its domain's posterior
    hosts = seen.select("host").distinct().join(counts, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    blocked = reputation(hosts, z, suffixes).filter((F.col("lower") > threshold) & (F.col("host") != "")).select("host", F.lit("block").alias("learnt"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return seen.join(blocked, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "learnt", F.lit("allow")).alias("verdict"))
