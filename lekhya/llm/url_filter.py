"""URL filter: explicit rules, then the empirical-Bayes reputation of the host."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.llm.common import attach, keep

#: Suffixes of two labels under which names are registered (fixed values, a common few of the public list).
TWO_LABEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr", "com.tw", "com.sg")
Z, FLOOR = 1.645, 0.5
#: Bounds of a level's fitted strength, in pseudo-observations.
WEAKEST, STRONGEST = 8.0, 1000.0


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    tail = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(tail, r"^[^/?#]*", 0)), F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column, two_label: Sequence[str] = TWO_LABEL) -> Column:
    """The last two labels of a host without its port, or three under a two-label suffix."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*two_label), F.substring_index(bare, ".", -3)).otherwise(two)


def suffix(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def rule_match(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule host/path that fits; nulls if none does. Equal lengths: the rule listed first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, mean: float) -> float:
    """Pseudo-observations of a beta prior shared by the groups (n, k), by the method of moments."""
    row = groups.where("n > 0").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") * 1.0).alias("nn"), F.sum(F.col("n") * (F.col("k") / F.col("n") - F.lit(mean)) * (F.col("k") / F.col("n") - F.lit(mean))).alias("w")).first()
    if not row or not row.n or row.g < 2:
        return STRONGEST
    v = mean * (1 - mean)
    room = row.n - row.nn / row.n - (row.g - 1)
    if v <= 0 or room <= 0:
        return STRONGEST
    rho = (row.w - v * (row.g - 1)) / (v * room)
    return STRONGEST if rho <= 0 else min(max((1 - rho) / rho, WEAKEST), STRONGEST)


def reputation(pages: DataFrame, outcomes: DataFrame, two_label: Sequence[str] = TWO_LABEL) -> DataFrame:
    """(host, mean, bound, pages): posterior mean and lower bound of the share of good pages, for each host.

    outcomes has page_id and good (boolean). Counts flow host -> registered domain -> suffix;
    beta-binomial priors flow back: a suffix shrinks to the overall share, a domain to its
    suffix, a host to its domain, with each level's strength fitted by moments. Bound: mean
    minus Z posterior deviations. Sums are partially aggregated, so a hot host is one row a
    task, and counted once, for the levels read the counts as they are kept; only one row of
    moments a level reaches the driver. two_label: suffixes under which names are registered.
    """
    rows = pages.select("page_id", "host").join(outcomes.select(F.col("page_id").alias("labelled"), "good"), F.col("page_id") == F.col("labelled"), "left")
    hosts = rows.groupBy("host").agg(F.count("good").alias("n"), F.count_if("good").alias("k"), F.count("*").alias("pages"))
    hosts = keep(hosts.withColumn("domain", registered_domain(F.col("host"), two_label)).withColumn("suffix", suffix(F.col("domain"))), "hosts")
    domains = keep(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = tops.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = ((total.k or 0) + 1.0) / ((total.n or 0) + 2.0)
    s_top, s_domain, s_host = (_strength(t, mean) for t in (tops, domains, hosts))
    tops = tops.select(F.col("suffix").alias("top"), ((F.lit(mean * s_top) + F.col("k")) / (F.lit(s_top) + F.col("n"))).alias("m_top"))
    domains = domains.join(tops, F.col("suffix") == F.col("top")).select(F.col("domain").alias("d"), ((F.col("m_top") * s_domain + F.col("k")) / (F.lit(s_domain) + F.col("n"))).alias("m_domain"))
    size = F.lit(s_host) + F.col("n")
    out = hosts.join(domains, F.col("domain") == F.col("d")).withColumn("mean", (F.col("m_domain") * s_host + F.col("k")) / size)
    return out.select("host", "pages", "mean", (F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], floor: float = FLOOR, two_label: Sequence[str] = TWO_LABEL) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page: the longest fitting rule's verdict, else allow if the host's bound reaches floor.

    Urls that are null or without :// have an empty host, which has a reputation like any
    other. Repeated rows are judged alike; labels of one page that disagree count as not
    good; a null page_id has no label. Other columns, whatever their names, are not read. An
    empty table gives no row; without outcomes every host has the prior's mean of a half.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    good = outcomes.where("page_id is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    known = reputation(own, good, two_label).select(F.col("host").alias("h"), "bound", "pages")
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    return attach(own, known, {"host": "h"}, "pages").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") >= floor, "allow").otherwise("block")).alias("verdict"))
