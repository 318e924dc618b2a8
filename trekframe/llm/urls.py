"""URL filtering: rules first, then trust and distrust spread over the graph of hosts.

A rule fits its host and all subdomains if the path starts with the rule's; the
longest fitting rule decides.  For pages without one, links in the pages' html
make a weighted graph of hosts.  Personalised PageRank spreads trust from hosts
by the share of their pages that a rule allows, along the links; distrust goes
from hosts by the share that is blocked, against them.  A host is blocked if its
distrust reaches ``threshold`` and exceeds its trust.

Ranks are power series of what is passed on, so rounds run until the rest of the
series is below ``tolerance`` for every host, and fail if ``max_rounds`` do not
reach that.  Rank tables have a row per host with rank, and each round is a join
and a sum with partial aggregation; a hub's links are dealt by Spark's skew join.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule, and verdict ``allow``; a null html has no links; links to the same host
or to none are no edges; repeated rows count as pages; a host that is only
linked to takes part; ties between rules of equal length go to the first listed;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    damping: float = 0.85
    threshold: float = 0.5
    tolerance: float = 1e-6  # of any host's trust or distrust, against the exact solution
    max_rounds: int = 400  # 400 rounds settle a start of 10 ** 20; not to settle in them is an error
    stride: int = 4  # rounds in one job


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.coalesce(rest, F.lit("")), F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how often pages of src link to dst."""
    href = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
    links = pages.where(F.contains("html", F.lit("//"))).select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(href), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src <> dst AND src <> '' AND dst <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(host, trust, distrust) from seeds(host, trust, distrust); a seed without links keeps its own value."""
    out = edges.groupBy("src").agg(F.sum("n").alias("t"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("t"))
    along = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("t")).alias("w"))
    against = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("t")).alias("w"))
    graph = stored(along.union(against), "graph")
    start = seeds.select("host", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("rank")) for k in ("trust", "distrust"))))).where("rank > 0")
    now = stored(start.select("kind", "host", "rank", F.col("rank").alias("step")), "ranks")
    for _ in range(0, s.max_rounds, s.stride):
        # what one round still moves bounds all that later ones can add: each moves at most damping times the one before
        left = 0.0 if graph.isEmpty() else now.agg(F.sum("step")).first()[0] or 0.0
        if left * s.damping / (1 - s.damping) < s.tolerance:
            break
        for _ in range(s.stride):
            moved = now.where("step > 0").join(graph, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("step") * F.col("w") * s.damping).alias("step"))
            held = now.select("kind", "host", "rank", F.lit(0.0).alias("step")).union(moved.select("kind", "host", F.col("step").alias("rank"), "step"))
            now = held.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("step").alias("step"))
        now = stored(now, "ranks")
    else:
        raise RuntimeError(f"trust did not settle to {s.tolerance} in {s.max_rounds} rounds")
    value = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k)
    return now.groupBy("host").agg(value("trust"), value("distrust"))


def judge(pages: DataFrame, rules=RULES, settings: Settings = Settings()) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page; trust and distrust are its host's."""
    s = settings
    host, path = split_url(F.col("url"))
    found = pages.select("page_id", host.alias("host"), path.alias("path"), *(["html"] if "html" in pages.columns else [F.lit(None).cast("string").alias("html")]))
    found = found.withColumn("r", ruled(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "html", "r.rule", F.col("r.verdict").alias("fixed"))
    share = lambda v: F.avg(F.when(F.col("fixed") == v, 1.0).otherwise(0.0))
    seeds = found.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    edges = stored(host_edges(found), "host-edges")
    score = spread(edges, seeds, s)
    blocked = (F.col("distrust") >= s.threshold) & (F.col("distrust") > F.col("trust"))
    rows = found.drop("html").join(score, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    return rows.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
