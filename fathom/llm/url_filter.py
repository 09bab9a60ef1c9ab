"""URL filters: rules first, then an empirical-Bayes reputation of the host.

Outcomes (blocked or allowed) of labelled pages are counted by host. A beta-binomial prior is fitted at each level by
moments and handed down: all pages -> suffix (last label) -> registered domain (last two labels, or three under a
suffix of `two_label_suffixes`) -> host. A page without a fitting rule is blocked if the lower posterior bound of its
host's block rate, mean - z * deviation, is over `limit`; hosts without outcomes have their domain's prior. Where nothing is
known of a host's suffix, the page is allowed: what all pages have in common is no reputation.

A null url, or one without "://", has an empty host and path, fits no rule and is allowed unless the outcomes of the empty
host say otherwise. Repeated rows are judged each. Without pages there is no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: (verdict, host, path prefix): the rules of query op9.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Public suffixes of two labels that query op9 knows; a caller with the whole list of such suffixes passes that.
TWO_LABEL_SUFFIXES = (
    "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my",
    "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.nz", "or.jp", "org.au", "org.br", "org.nz", "org.uk", "org.za",
)
LIMIT, Z, WEIGHT = 0.5, 1.645, 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (verdict, rule), or null."""
    fit = None
    for verdict, at, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        one = F.struct(F.lit(verdict).alias("verdict"), F.lit(at + prefix).alias("rule"))
        holds = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        fit = F.when(holds, one) if fit is None else fit.when(holds, one)
    return fit if fit is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def domain_of(host: Column, two_label_suffixes=()) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label_suffixes), F.substring_index(host, ".", -3)).otherwise(two) if two_label_suffixes else two


def suffix_of(host: Column, two_label_suffixes=()) -> Column:
    two, one = F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)
    return F.when(two.isin(*two_label_suffixes), two).otherwise(one) if two_label_suffixes else one


def reputation(outcomes: DataFrame, weight: float = WEIGHT, two_label_suffixes=()) -> dict[str, DataFrame]:
    """Posterior (mean, strength) of the block rate by host, domain and suffix, and of all, from rows (host, blocked 0/1).

    The strength that a level hands down is `weight` divided by what its children differ by: between-child variance over
    the binomial variance, limited to [1, 100] pseudo outcomes.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("blocked").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    hosts = hosts.select("host", domain_of(F.col("host"), two_label_suffixes).alias("domain"), suffix_of(F.col("host"), two_label_suffixes).alias("suffix"), "k", "n")
    spread = lambda k, n: F.avg(F.pow(F.col(k) / F.col(n), 2)) - F.pow(F.avg(F.col(k) / F.col(n)), 2)
    level = lambda rows: rows.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), spread("k", "n").alias("v"))
    domains = level(hosts.groupBy("domain", "suffix"))
    suffixes = level(domains.select("domain", "suffix", "k", "n").groupBy("suffix"))
    everything = level(suffixes.select("suffix", "k", "n").groupBy())
    mean = lambda k, n, m, s: (F.col(k) + F.col(m) * F.col(s)) / (F.col(n) + F.col(s))
    own = lambda m, v: F.least(F.lit(100.0), F.greatest(F.lit(1.0), weight * F.col(m) * (1 - F.col(m)) / (F.col(v) + 1e-6)))
    top = everything.select(((F.coalesce(F.col("k"), F.lit(0.0)) + 0.5) / (F.coalesce(F.col("n"), F.lit(0.0)) + 1)).alias("m0"), F.coalesce(F.col("v"), F.lit(0.0)).alias("v")).select("m0", own("m0", "v").alias("s0"))
    # one row joins all suffixes: top is a total, never more than a row
    suffixes = suffixes.join(F.broadcast(top)).select("suffix", mean("k", "n", "m0", "s0").alias("m1"), "v").select("suffix", "m1", own("m1", "v").alias("s1"))
    domains = domains.join(suffixes, "suffix").select("domain", mean("k", "n", "m1", "s1").alias("m2"), "v").select("domain", "m2", own("m2", "v").alias("s2"))
    hosts = hosts.join(domains, "domain").select("host", mean("k", "n", "m2", "s2").alias("m3"), (F.col("n") + F.col("s2")).alias("s3"))
    return {"host": hosts, "domain": domains, "suffix": suffixes, "all": top}


def judge(pages: DataFrame, outcomes: DataFrame | None = None, rules=RULES, limit: float = LIMIT, z: float = Z, two_label_suffixes=()) -> DataFrame:
    """Rows with page_id and url to (page_id, host, path, rule, verdict, block_rate, bound).

    outcomes: rows (host, blocked); without them, the verdicts of the rules on `pages` are the labelled outcomes.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    if outcomes is None:
        outcomes = judged.filter("fit is not null").select("host", (F.col("fit.verdict") == "block").cast("int").alias("blocked"))
    known = reputation(outcomes, two_label_suffixes=two_label_suffixes)
    hosts = judged.select("host").distinct().select("host", domain_of(F.col("host"), two_label_suffixes).alias("domain"), suffix_of(F.col("host"), two_label_suffixes).alias("suffix"))
    hosts = hosts.join(known["host"], "host", "left").join(known["domain"], "domain", "left").join(known["suffix"], "suffix", "left").join(F.broadcast(known["all"]))
    rate, strength = F.coalesce("m3", "m2", "m1", "m0"), F.coalesce("s3", "s2", "s1", "s0")
    bound = F.when(F.coalesce("m3", "m2", "m1").isNotNull(), rate - z * F.sqrt(rate * (1 - rate) / (strength + 1)))
    hosts = hosts.select("host", rate.alias("block_rate"), bound.alias("bound"))
    return judged.join(hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"),
        "block_rate",
        "bound",
    )
