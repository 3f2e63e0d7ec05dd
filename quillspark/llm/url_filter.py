"""URL filters by rules and by empirical-Bayes host reputation.

host is what follows the first :// up to /, ?, # or the end, A-Z lower-cased; path what follows up to ?, # or the end;
both are empty where the url is null or has no ://.  A rule `domain/path` fits its host and all subdomains if the
path starts with the rule's; of the rules that fit the longest decides (ties: smallest by code point).

Other urls get the method's verdict.  Labelled pages are outcomes: bad if toxic or of low quality.  Counts go up from
host to registered domain to suffix to all.  At each level the rate is shrunk towards its parent's by a beta prior;
the prior's weight k comes from the overdispersion of children about their parents (method of moments, held to
1..1000).  A host is blocked when the lower bound of its posterior (mean - Z sd) is above BAD.  A host without labels
takes its domain's posterior as its own, and so on.  A port is no part of the names that reputations go by.

The suffix is the last label, or the last two if the last has two letters and the one before is of the second-level
names below; hosts of numbers or of one label are their own domain.  A page with several labels counts each; a null
label field counts as good.  The empty table gives an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Cuts, lookup_join

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "or", "org")
BAD, Z = 0.5, 1.645


def host(url: Column) -> Column:
    after = F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides and its verdict (nulls without one)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # the last that fits wins
        name, start = text.split("/", 1)
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def names(host_: Column) -> tuple[Column, Column, Column]:
    """Host without port, registered domain, suffix."""
    bare = F.regexp_replace(host_, ":[0-9]*$", "")
    two = f"[^.]+\\.(?:{'|'.join(SECOND_LEVEL)})\\.[a-z]{{2}}$"
    number = bare.rlike("^[0-9.]+$")
    domain = F.when(number, bare).when(bare.rlike("(^|\\.)" + two), F.regexp_extract(bare, two, 0)).otherwise(F.regexp_extract(bare, "[^.]+\\.[^.]+$", 0))
    domain = F.when(domain == "", bare).otherwise(domain)
    return bare, domain, F.when(number, F.lit("")).otherwise(F.regexp_extract(domain, "^[^.]*\\.?(.*)$", 1))


def _weight(children: DataFrame, m: str) -> float:
    """The prior's weight, from children (n, bad) and their parents' rate m: one number."""
    s = F.sum(F.pow(F.col("bad") - F.col("n") * F.col(m), 2) / F.col("n"))
    v = F.sum(F.col(m) * (1 - F.col(m)))
    over = F.sum((F.col("n") - 1) * F.col(m) * (1 - F.col(m)))
    got = children.where("n > 0").agg(s.alias("s"), v.alias("v"), over.alias("over")).first()
    if not got["over"]:
        return 10.0
    rho = (got["s"] - got["v"]) / got["over"]
    return min(1000.0, max(1.0, 1 / rho - 1)) if rho > 0 else 1000.0


def reputations(cuts: Cuts, hosts: DataFrame) -> DataFrame:
    """hosts (bare, domain, suffix, n, bad) -> each with its posterior's mean and lower bound."""
    total = hosts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    m0 = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)

    def shrunk(level: DataFrame, parent: str, mean: str) -> tuple[DataFrame, float]:
        k = _weight(level, parent)
        return level.withColumn(mean, (k * F.col(parent) + F.col("bad")) / (k + F.col("n"))), k

    suffix = cuts.cut(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("m0", F.lit(m0)))
    suffix = shrunk(suffix, "m0", "ms")[0].select("suffix", "ms")
    domain = cuts.cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffix, "suffix"))
    domain = shrunk(domain, "ms", "md")[0].select("domain", "suffix", "md")
    each, k = shrunk(cuts.cut(hosts.join(domain, ["domain", "suffix"])), "md", "mean")
    return each.withColumn("low", F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (k + F.col("n") + 1)))


def url_filter(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row a page: id, host, path, rule, verdict.  labels (doc_id, quality, toxic) are of pages by id."""
    cuts = Cuts(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    bare, domain, suffix = names(F.col("host"))
    rows = cuts.cut(rows.withColumn("bare", bare))
    bad = ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("long")
    told = labels.select(F.col("doc_id").alias("_id"), bad.alias("bad"))
    told = told.groupBy("_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    counts = rows.join(told, "_id", "left").groupBy("bare").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    _, domain, suffix = names(F.col("bare"))
    hosts = cuts.cut(counts.withColumn("domain", domain).withColumn("suffix", suffix))
    rep = cuts.cut(reputations(cuts, hosts).select("bare", "pages", "low"))
    out = lookup_join(rows, rep, "bare", "pages")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return out.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("low") > BAD, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.round("low", 9).alias("bad_lower_bound"))
