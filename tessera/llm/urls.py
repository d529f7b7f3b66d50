"""URL filters: host rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are shrunk through beta-binomial priors: a host towards the rest of its registered domain, that
towards the rest of its suffix, that towards the rest of the corpus; no outcome counts on two levels.  The strength of each
level's prior is estimated from the spread of its groups within their parents (a one-way analysis of variance) and is at most
``MAX_STRENGTH`` pages, so that a host's own pages soon speak for themselves.  A host is blocked when the lower posterior bound
of its share of bad pages is above the corpus's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.llm.common import staged

#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Public suffixes of two labels that a registered domain is counted from.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr", "com.tw", "com.sg")
MAX_RULES = 200
#: What a prior counts at most, in pages.
MAX_STRENGTH = 10.0


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def registered_domain(host: Column) -> tuple[Column, Column]:
    """(domain, suffix) of a host, its port left out; an address of numbers is a domain of its own, without suffix."""
    name = F.regexp_replace(host, r":\d*$", "")
    number = F.rlike(name, F.lit(r"^[0-9.]+$|^\["))
    double = F.substring_index(name, ".", -2).isin(*DOUBLE_SUFFIXES)
    domain = F.when(number, name).when(double, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    suffix = F.when(number, F.lit("")).when(double, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


def _spread(groups: DataFrame) -> Row:
    """Sums over ``groups`` (n, bad, sq), where ``sq`` is the sum of the squared n of a group's parts."""
    per_n = lambda x: F.coalesce(F.sum(F.when(F.col("n") > 0, x / F.col("n").cast("double"))), F.lit(0.0))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count(F.when(F.col("n") > 0, 1)).alias("k"), per_n(F.col("bad") * F.col("bad")).alias("s"), per_n(F.col("sq")).alias("q")).first()


def _strength(groups: Row, parents: Row) -> float:
    """How many pages the prior of the groups within their parents counts, from 1 to MAX_STRENGTH."""
    n, more = groups["n"], groups["k"] - parents["k"]
    if more <= 0 or n <= groups["k"]:
        return MAX_STRENGTH
    between, within = (groups["s"] - parents["s"]) / more, (groups["bad"] - groups["s"]) / (n - groups["k"])
    size = (n - parents["q"]) / more
    if within <= 0 or between <= within:
        return MAX_STRENGTH if within > 0 else 1.0
    rho = (between - within) / (between + (size - 1) * within)
    return max(1.0, min(MAX_STRENGTH, round((1 - rho) / rho, 3)))


def host_reputation(hosts: DataFrame, z: float = 1.28) -> tuple[DataFrame, float]:
    """(host, n, bad, mean, bound): posterior mean and lower bound of the share of bad pages; and the corpus's share.

    ``hosts`` has one row (host, n, bad) per host.  The bound is the mean less ``z`` deviations of the posterior: about its
    tenth percentile.  Without labels all means are one half.  The driver sees a few sums per level.
    """
    domain, suffix = registered_domain(F.col("host"))
    hosts = staged(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "url-hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("sq")]
    domains = staged(hosts.groupBy("domain", "suffix").agg(*sums), "url-domains")
    suffixes = staged(domains.groupBy("suffix").agg(*sums), "url-suffixes")
    spreads = [_spread(hosts.withColumn("sq", F.lit(0))), _spread(domains), _spread(suffixes), _spread(suffixes.agg(*sums))]
    of_host, of_domain, of_suffix = (F.lit(_strength(*pair)) for pair in zip(spreads, spreads[1:], strict=False))
    total, bad = spreads[3]["n"], spreads[3]["bad"]
    share = bad / total if total else 0.5
    s = suffixes.select("suffix", F.col("n").alias("sn"), F.col("bad").alias("sb"))
    d = domains.select("domain", "suffix", F.col("n").alias("dn"), F.col("bad").alias("db"))
    # The rest of the corpus, with one page at the corpus's share, so that there always is a rest.
    rest = (F.lit(bad) - F.col("sb") + F.lit(share)) / (F.lit(total) - F.col("sn") + F.lit(1.0))
    above = (F.col("sb") - F.col("db") + of_suffix * rest) / (F.col("sn") - F.col("dn") + of_suffix)
    priors = d.join(s, "suffix").select("domain", "suffix", "dn", "db", above.alias("above"))
    prior = (F.col("db") - F.col("bad") + of_domain * F.col("above")) / (F.col("dn") - F.col("n") + of_domain)
    told = hosts.join(priors, ["domain", "suffix"]).withColumn("mean", (F.col("bad") + of_host * prior) / (F.col("n") + of_host))
    bound = F.greatest(F.lit(0.0), F.col("mean") - F.lit(float(z)) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + of_host + 1)))
    return told.select("host", "n", "bad", "mean", bound.alias("bound")), share


def filter_urls(pages: DataFrame, labels: DataFrame, *, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", z: float = 1.28, lift: float = 1.0) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_mean, bad_bound.

    A label belongs to the page of the same id; a page is bad if some label calls it toxic or of quality 0.  Labels without
    a page are ignored, a null label counts as good.  The longest fitting rule decides; else the host's reputation, which
    blocks a host whose bound is above ``lift`` times the corpus's share of bad pages.  A null
    url or one without ``://`` has an empty host, which is a host like any other.  Repeated pages each get a row.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    is_bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    outcome = labels.groupBy(F.col(label_id).alias("page_id")).agg(F.max(is_bad.cast("long")).alias("is_bad"))
    judged = base.select("page_id", "host").join(outcome, "page_id", "left")
    hosts = judged.groupBy("host").agg(F.count("is_bad").alias("n"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    fame, share = host_reputation(hosts, z)
    matched = match_rule(F.col("host"), F.col("path"), rules)
    # One host may hold a third of all pages: the join is a plain equality that adaptive execution splits.
    return base.join(fame.select("host", "mean", "bound"), "host").withColumn("hit", matched).select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("bound") > lift * share, "block").otherwise("allow")).alias("verdict"),
        F.round("mean", 6).alias("bad_mean"),
        F.round("bound", 6).alias("bad_bound"),
    )
