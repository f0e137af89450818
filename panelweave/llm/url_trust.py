"""URL filtering by rules and by trust that travels along host links.

A rule names a host and a path prefix and fits that host with all subdomains; the longest fitting rule decides.
URLs without a rule are judged by their host: personalised PageRank spreads trust from hosts with allowed pages
along links, and distrust from hosts with blocked pages against them; a host is blocked where its share of
distrust reaches the threshold.

Mass is counted in whole units of 2^-50 and passed on rounded down, so sums don't depend on their order and
reruns agree exactly. Walks that reach a host without links end there. Rounds go on until no host's mass changes by
a unit, and for 214 at most: what has then not arrived is less than one unit of all mass, and only rounding still moves.

Null URLs and URLs without `://` have an empty host and path, fit no rule and are allowed. Repeated rows count as
pages of their own. Links are the `href` and `src` targets that begin with a scheme and `://`, in any case, quoted
or bare, wherever the page has them; `//host/path` is relative to the page's scheme and no edge. Links within a host
are not edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from panelweave.llm.storage import remove, written
from panelweave.operators.skew import attach_groups

DAMPING = 0.85
THRESHOLD = 0.5
UNIT = 1 << 50
# After so many links the damping leaves less than one unit of all mass.
ITERATIONS = ceil(log(UNIT) / -log(DAMPING))
# Double-quoted, single-quoted and bare values, up to the end of the host; written without a quote so that SQL can hold it.
LINK = r"(?:[hH][rR][eE][fF]|[sS][rR][cC])[ \t\n\f\r]*=[ \t\n\f\r]*[\"\x27]?[ \t\n\f\r]*([A-Za-z][A-Za-z0-9+.-]*://[^ \t\n\f\r\"\x27<>/?#]*)"
HOST = "://([^/?#]*)"
PATH = "://[^/?#]*([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A verdict, allow or block, for a host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """`value(rule)` of the longest rule that fits, else null; equally long rules: the longer host first."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, value(rule)) if found is None else found.when(fits, value(rule))
    return F.lit(None).cast("string") if found is None else found


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per page: the `keep` columns, host, path, rule, verdict, host_trust, host_distrust."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    ruled = pages.select(*keep, F.col(html).alias("__html"), host.alias("host"), path.alias("path"))
    ruled = ruled.select(
        "*",
        longest_rule(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.text)).alias("rule"),
        longest_rule(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.verdict)).alias("ruled"),
    )
    scores = host_scores(ruled.select("host", "ruled", F.col("__html").alias("html")))
    rows = attach_groups(ruled.drop("__html"), scores, ["host"])
    trust, distrust = (F.coalesce(c, F.lit(0)) for c in ("trust", "distrust"))
    blocked = (distrust > 0) & (distrust >= THRESHOLD * (trust + distrust))
    verdict = F.coalesce("ruled", F.when(blocked, F.lit("block")).otherwise("allow"))
    return rows.select(*keep, "host", "path", "rule", verdict.alias("verdict"), trust.alias("host_trust"), distrust.alias("host_distrust"))


def host_scores(pages: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(host, trust, distrust) in units of 2^-50, from pages (host, ruled, html)."""
    seeds = written(
        pages.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block")),
        "seeds",
    )
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
    links = links.select(F.col("host").alias("a"), host_of(F.col("link")).alias("b")).where("b <> '' AND a <> b")
    edges = written(links.groupBy("a", "b").agg(F.count("*").alias("n")), "host-links")
    # Trust follows links, distrust goes back along them; both spread in the same jobs.
    ways = edges.select(F.lit("trust").alias("kind"), "a", "b", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    out = ways.groupBy("kind", "a").agg(F.sum("n").alias("out"))
    ways = attach_groups(ways, out, ["kind", "a"]).select("kind", "a", "b", (F.lit(damping) * F.col("n") / F.col("out")).alias("weight"))
    ways = written(ways, "ways")
    allowed, blocked = (x or 0 for x in seeds.agg(F.sum("allow"), F.sum("block")).first())
    # As a double, since all mass times the pages of one host outgrows 64 bits at 8,192 pages; a power of two keeps the product exact.
    sources = [
        seeds.select(F.lit(kind).alias("kind"), "host", F.floor(F.lit(float(UNIT)) * F.col(column) / max(total, 1)).alias("mass"))
        for kind, column, total in (("trust", "allow", allowed), ("distrust", "block", blocked))
    ]
    start = written(sources[0].unionByName(sources[1]).where("mass > 0"), "mass")
    kept = start.select("kind", "host", F.floor(F.col("mass") * F.lit(1 - damping)).alias("mass"))
    mass = start
    for _ in range(iterations):
        moved = Observation()
        here = mass.select("kind", F.col("host").alias("a"), "mass")
        flows = attach_groups(ways, here, ["kind", "a"], "inner").select("kind", F.col("b").alias("host"), F.floor(F.col("mass") * F.col("weight")).alias("mass"))
        parts = kept.unionByName(flows).withColumn("before", F.lit(0)).unionByName(mass.select("kind", "host", F.lit(0).alias("mass"), F.col("mass").alias("before")))
        sums = parts.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("before").alias("before"))
        sums = sums.observe(moved, F.sum(F.abs(F.col("mass") - F.col("before"))).alias("units"))
        following = written(sums.select("kind", "host", "mass"), "mass")
        if mass is not start:
            remove(mass)
        mass = following
        if not moved.get["units"]:
            break
    either = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass"))).alias(kind)
    return mass.groupBy("host").agg(either("trust"), either("distrust"))
