"""Url verdicts: fixed rules first, then the reputation of the host, shrunk towards its domain and suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(rest, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. A rule is (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, below in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(below)
        rule, verdict = F.when(fits, at + below).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column, labels: int = 2) -> Column:
    """The last labels of a host: its registered domain for suffixes of one label, and with labels=1 its suffix."""
    return F.substring_index(host, ".", -labels)


def host_reputation(outcomes: DataFrame, host_col: str = "host", bad_col: str = "bad", *, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """Posterior share of bad pages of every host: (host, domain, suffix, labelled, bad, mean, deviation).

    outcomes has one row per page; bad is true, false, or null where nothing is known. Each level has a beta prior
    around its parent's posterior mean: hosts around their registered domain, domains around their suffix, suffixes around
    the share of all labelled pages (one half if none is). A prior weighs as many pages as the method of moments finds from
    the spread of the children's shares around the mean of all, kept between `least` and `most`; without any spread to
    measure it weighs `least`. Pages are counted per host at once, partly before the shuffle; the upper levels add up hosts.

    A null host counts as the empty host. Repeated rows count each. An empty table gives an empty result.
    """
    host = F.coalesce(F.col(host_col), F.lit("")).alias("host")
    hosts = outcomes.groupBy(host).agg(F.count(F.col(bad_col)).alias("labelled"), F.count(F.when(F.col(bad_col), 1)).alias("bad"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": domain_of(F.col("host"), 1)})
    hosts = materialize(hosts, "reputation-hosts")
    counts = (F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    share = F.when(F.sum("labelled") > 0, F.sum("bad") / F.sum("labelled")).otherwise(0.5)
    base = suffixes.agg(share.alias("base"))

    def weight(level: DataFrame) -> Column:
        """Pages that a prior at this level is worth, as one row to be joined: from the variance between its groups."""
        rate = F.col("bad") / F.col("labelled")
        mean, n, groups = F.sum("bad") / F.sum("labelled"), F.sum("labelled"), F.count(F.lit(1))
        moments = level.where("labelled > 0").agg(
            mean.alias("m"), n.alias("n"), groups.alias("g"), F.sum(F.col("labelled") * rate * rate).alias("sq"), F.sum(F.col("labelled") * F.col("labelled")).alias("nn")
        )
        # between-group variance beyond what counting alone would give
        spread = F.col("sq") - F.col("n") * F.col("m") * F.col("m")
        noise = F.col("m") * (1 - F.col("m"))
        between = (spread - (F.col("g") - 1) * noise) / F.nullif(F.col("n") - F.col("nn") / F.col("n"), F.lit(0))
        found = F.when((F.col("g") > 1) & (between > 0), noise / between - 1).when(F.col("g") > 1, most)
        return moments.select(F.least(F.greatest(F.coalesce(found, F.lit(least)), F.lit(least)), F.lit(most)).alias("w"))

    def posterior(level: DataFrame, parent: Column, w: str) -> Column:
        return (F.col("bad") + F.col(w) * parent) / (F.col("labelled") + F.col(w))

    # each of these has exactly one row
    single = base
    for level, name in ((suffixes, "ws"), (domains, "wd"), (hosts, "wh")):
        single = single.join(F.broadcast(weight(level).withColumnRenamed("w", name)), how="inner", on=F.lit(True))
    single = F.broadcast(single)
    s = suffixes.join(single, F.lit(True)).select("suffix", posterior(suffixes, F.col("base"), "ws").alias("of_suffix"))
    d = domains.join(s, "suffix").join(single.select("wd"), F.lit(True)).select("domain", posterior(domains, F.col("of_suffix"), "wd").alias("of_domain"))
    d = materialize(d, "reputation-domains")
    h = hosts.join(d, "domain").join(single.select("wh"), F.lit(True))
    mean, size = posterior(h, F.col("of_domain"), "wh"), F.col("labelled") + F.col("wh")
    h = h.withColumn("mean", mean).withColumn("deviation", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1)))
    return h.select("host", "domain", "suffix", "labelled", "bad", "mean", "deviation")


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", *, bound: float = 0.5, sigmas: float = 1.0) -> DataFrame:
    """(id_col, host, path, rule, verdict, bad_share) of every page.

    A page that a rule fits gets its verdict, and is a labelled outcome of its host. Any other page is blocked if the
    lower posterior bound (mean less `sigmas` deviations) of its host's share of bad pages is above `bound`.

    A null url, or one without `://`, has an empty host and path. Null and repeated ids are judged row by row; an empty table
    gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    known = host_reputation(rows.withColumn("bad", F.col("said") == "block"))
    known = materialize(known.select("host", F.col("mean").alias("bad_share"), (F.col("mean") - sigmas * F.col("deviation")).alias("lower")), "reputation")
    verdict = F.coalesce(F.col("said"), F.when(F.col("lower") > bound, "block").otherwise("allow"))
    return rows.join(known, "host").select(id_col, "host", "path", "rule", verdict.alias("verdict"), "bad_share")
