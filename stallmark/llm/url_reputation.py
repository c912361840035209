"""URL filtering: listed rules first, then empirical-Bayes host reputation.

Labelled page outcomes (good or not) are counted by host. A host's rate is
shrunk towards that of its registered domain, a domain's towards that of its
suffix, a suffix's towards the overall rate, each by a beta-binomial prior whose
strength is estimated from how much the rates of that level differ beyond
chance (moments). A host is allowed if a lower bound of its posterior reaches
``floor``. Only counts for each host are shuffled; pages meet them in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import cut, cut_seen, small

#: A page is blocked if its posterior rate of good pages, less Z posterior deviations, is below this share of the overall rate.
FLOOR, Z = 0.75, 1.64
#: Suffixes of more than one label, under which the registered domain has one label more. A deployment passes a full list.
SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix (or the whole host)."""
    return F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(counts: DataFrame, level: str) -> float:
    """Pseudo-count of the beta prior over the rates of a level, by moments; between 1 and 1e4."""
    g = counts.groupBy(level).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    r = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q")).first()
    if not r.n or r.k < 2:
        return 10.0
    p = r.s / r.n
    within = p * (1 - p)
    spread = r.q - r.n * p * p
    extra = within * (r.n - r.n2 / r.n - (r.k - 1))
    rho = (spread - within * (r.k - 1)) / extra if extra > 0 else 0.0
    return float(min(1e4, max(1.0, 1 / max(rho, 1e-9) - 1)))


def reputation(hosts: DataFrame, outcomes: DataFrame, *, floor: float = FLOOR, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """A row for each row of hosts (column ``host``, distinct): ``host, rate, bound, good``.

    ``outcomes`` has host and good (boolean or 0/1); rows with a null in either
    do not count. Without any outcome each rate is 1/2 and every host is good.
    """
    counts = outcomes.dropna(subset=["host", "good"]).groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("good").cast("double")).alias("s"))
    # Written, as all that follows reads it again and again: a row for each host with outcomes.
    counts = cut(counts).withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    total = counts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = (total.s + 1) / (total.n + 2) if total.n else 0.5
    k = {level: _strength(counts, level) for level in ("suffix", "domain", "host")}
    by_domain = counts.groupBy("domain").agg(F.sum("n").alias("nd"), F.sum("s").alias("sd"))
    by_suffix = counts.groupBy("suffix").agg(F.sum("n").alias("ns"), F.sum("s").alias("ss"))
    out = hosts.select("host").withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    out = out.join(counts.select("host", "n", "s"), "host", "left").join(by_domain, "domain", "left").join(by_suffix, "suffix", "left").na.fill(0.0, ["n", "s", "nd", "sd", "ns", "ss"])
    # Each level adds what the level below has not counted already.
    suffix_rate = (F.lit(k["suffix"] * overall) + F.col("ss") - F.col("sd")) / (F.lit(k["suffix"]) + F.col("ns") - F.col("nd"))
    domain_rate = (F.lit(k["domain"]) * suffix_rate + F.col("sd") - F.col("s")) / (F.lit(k["domain"]) + F.col("nd") - F.col("n"))
    size = F.lit(k["host"]) + F.col("n")
    rate = (F.lit(k["host"]) * domain_rate + F.col("s")) / size
    bound = rate - F.lit(z) * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (size + 1))
    good = bound >= floor * overall if total.n else F.lit(True)
    return out.select("host", rate.alias("rate"), bound.alias("bound"), good.alias("good"))


def rules_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) of the distinct hosts that a rule is for: structs (rule, path, action), the one that wins first."""
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = rules.select(F.col("host").alias("end"), "path", "action").dropna().distinct()
    met = hosts.select("host", F.explode(ends).alias("end")).join(listed, "end")
    rule = F.concat("end", "path")
    found = F.struct((-F.length(rule)).alias("size"), rule.alias("rule"), (F.col("action") != "block").alias("allows"), "path", "action")
    return met.groupBy("host").agg(F.sort_array(F.collect_list(found)).alias("rules"))


def judge(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], outcomes: DataFrame, *, page_id: str = "page_id", url: str = "url", **options) -> DataFrame:
    """A row for each row of pages: ``page_id, host, path, rule, verdict, rate, bound``.

    ``rules`` are any number of (action, host, path) with the action allow or block, as a list or
    a DataFrame; they meet the distinct hosts by a join. A rule fits its host and all
    subdomains if the path starts with the rule's; the longest host and path
    wins, of equally long ones the smallest text, and of equal ones block.
    ``rule`` is its host and path, else null. Without a rule the verdict is the
    reputation's; a url that is null or has no ``://`` has an empty host and is
    judged by the overall rate. Repeated rows stay, other columns are ignored; no pages give no rows.
    """
    if isinstance(rules, list):
        rules = pages.sparkSession.createDataFrame(rules, "action string, host string, path string")
    seen = pages.select(F.col(page_id), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = cut(seen.select("host").distinct())
    # Written and counted: it is broadcast if small, else both sides of the join are plain exchanges, and AQE can split a host of very many pages.
    known, size = cut_seen(reputation(hosts, outcomes, **options).join(rules_of(hosts, rules), "host", "left"), F.sum(F.size("rules")).alias("listed"))
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    out = seen.join(small(known, size["n"] + max(size["listed"] or 0, 0)), "host", "left").withColumn("first", first)
    verdict = F.coalesce(F.col("first.action"), F.when(F.col("good"), "allow").otherwise("block"))
    return out.select(page_id, "host", "path", F.col("first.rule").alias("rule"), verdict.alias("verdict"), "rate", "bound")
