"""URL verdicts from rules, and from trust and distrust that spread over links between hosts.

A rule allows or blocks a host with its subdomains below a path; the longest rule that fits decides.  Where none fits, the host
decides.  Trust starts at hosts with allowed pages and follows links; distrust starts at hosts with blocked pages and follows
links backwards (who links to bad hosts is suspect).  Both are personalised PageRank, a fixed number of rounds over
a table of distinct host edges, in whole units (2^-40 of all trust), so that results do not depend on the order of sums.
A host is blocked if more than half of what reached it is distrust.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.session import cut_lineage

UNITS = 1 << 40
DAMPING = 85  # percent that is passed on
ROUNDS = 10
KEEP = 3  # rounds between written tables


@dataclass(frozen=True)
class Rule:
    """verdict for urls whose host is ``host`` or below it and whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values
RULES = (
    Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
    return host & F.col("path").startswith(rule.path)


def by_rule(rules: tuple[Rule, ...], value) -> Column:
    """The value of the longest rule that fits (by its name; of equal ones the first), else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        found = F.when(fits(rule), F.lit(value(rule))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts in href attributes of html; links without :// stay on a host."""
    link = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1)))
    links = pages.select(F.col("host").alias("src"), link.alias("link")).where(F.col("link").contains("://"))
    return links.select("src", host_of(F.col("link")).alias("dst")).where("src != '' AND dst != '' AND src != dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, mass): personalised PageRank of ``seeds`` (host, mass) along ``edges`` (src, dst).

    Each round a host passes DAMPING percent on, in equal parts, and each seed gets the rest of its mass back.  What a host
    without links would pass on is lost.  Whole units only: each part is rounded down.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    edges = cut_lineage(edges.join(degree, "src"))
    restart = cut_lineage(seeds.select("host", F.expr(f"mass * {100 - DAMPING} div 100").alias("mass")))
    mass = seeds
    for i in range(1, rounds + 1):
        sent = mass.withColumnRenamed("host", "src").join(edges, "src")
        sent = sent.select(F.col("dst").alias("host"), F.expr(f"mass * {DAMPING} div (100 * degree)").alias("mass"))
        mass = sent.unionByName(restart).groupBy("host").agg(F.sum("mass").alias("mass")).where("mass > 0")
        mass = cut_lineage(mass) if i % KEEP == 0 else mass
    return mass


def _seeds(judged: DataFrame, verdict: str) -> DataFrame:
    """(host, mass): UNITS dealt to hosts by their number of pages with that verdict."""
    counts = judged.where(F.col("verdict") == verdict).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return cut_lineage(counts.select("host", F.expr(f"CAST({UNITS // total} * n AS BIGINT)").alias("mass")))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """``pages`` with host, path, rule and verdict, and trust and distrust of the host in units.

    A null url, and one without ://, has an empty host and path, fits no rule and is allowed; so is a host that neither
    reaches.  A null html has no links.  All rows and other columns stay; columns named like the results are replaced.
    An empty table gives an empty result.
    """
    made = ("host", "path", "rule", "verdict", "trust", "distrust")
    own = pages.drop(*made).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    own = own.withColumns({"rule": by_rule(rules, lambda r: r.name), "verdict": by_rule(rules, lambda r: r.verdict)})
    judged = cut_lineage(own.select("host", "verdict"))
    edges = cut_lineage(host_edges(own))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    trust = spread(edges, _seeds(judged, "allow"), rounds).withColumnRenamed("mass", "trust")
    distrust = spread(back, _seeds(judged, "block"), rounds).withColumnRenamed("mass", "distrust")
    hosts = cut_lineage(trust.join(distrust, "host", "full")).fillna(0, ["trust", "distrust"])
    found = own.join(hosts, "host", "left").fillna(0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") > F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("verdict", F.coalesce("verdict", by_host)).select(
        *[c for c in pages.columns if c not in made], *made
    )
