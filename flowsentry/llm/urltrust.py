"""URL filter: rules first, then link-graph propagation over host edges.

Trust is a personalised PageRank that starts from hosts whose pages rules allow; distrust is one over the reversed
links that starts from hosts whose pages rules block, so a host that links to bad hosts is distrusted. A page that no
rule fits is blocked if distrust makes up at least `BLOCK_AT` of its host's trust and distrust; a host that neither
reaches is allowed. Everything is DataFrame operations: links are counted per pair of hosts before anything is joined.

Defined results: a null url, or one without `://`, has an empty host and path; rules fit no empty host. A null page has
no links. Repeated rows are each judged and each count. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.session import checkpointed, shuffles_removed

DAMPING, BLOCK_AT = 0.7, 0.6
# Levels have settled when none changes by more than this part of it; looked at every few rounds.
SETTLED, ROUNDS_BETWEEN = 1e-6, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains, on paths that start with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a url."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    column = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(column, whole, 1), UPPER, LOWER), F.regexp_extract(column, whole, 2)


def fitting(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(source, target, links): absolute links of pages between different hosts."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"), F.lit(1))
    return pages.filter(F.col(html).contains("//")).select(F.col(host).alias("source"), F.explode(found).alias("target")) \
        .withColumn("target", F.translate("target", UPPER, LOWER)).filter("source != target and source != ''") \
        .groupBy("source", "target").agg(F.count("*").alias("links"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust); both directions move in one pass per round.

    Rounds go on until they reach no further host and change no level by more than `settled` of it, however long the
    chains of links are. What hosts without links on would pass on returns to the seeds: that makes all levels of a
    direction greater by the same factor, so in the end they are scaled to add up to the seeds.
    """
    forward = links.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "links")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "links")
    both = forward.union(backward)
    out = both.groupBy("kind", "host").agg(F.sum("links").alias("all"))
    edges = checkpointed(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("all")).alias("part")))
    given = seeds.select("host", F.explode(F.create_map(
        F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "seed")).filter("seed > 0")
    start = checkpointed(given.groupBy("kind", "host").agg(F.sum("seed").alias("seed")))
    level = start.select("kind", "host", F.col("seed").alias("level"))
    kept = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("level"))
    if edges.limit(1).count():  # else nothing moves: the seeds are the fixed point
        while True:
            last = level
            for _ in range(ROUNDS_BETWEEN):
                moved = level.join(edges, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")) \
                    .agg((F.sum(F.col("level") * F.col("part")) * damping).alias("level"))
                level = moved.union(kept).groupBy("kind", "host").agg(F.sum("level").alias("level"))
            level = checkpointed(level)
            step = F.abs(F.coalesce("level", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))) / F.greatest("level", "before")
            changed = level.join(last.withColumnRenamed("level", "before"), ["kind", "host"], "full").filter(step > settled)
            with shuffles_removed(links.sparkSession):
                if changed.limit(1).count() == 0:
                    break
        whole = start.groupBy("kind").agg(F.sum("seed").alias("seeds")).join(
            level.groupBy("kind").agg(F.sum("level").alias("levels")), "kind")  # two rows at most
        level = level.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("level") * F.col("seeds") / F.col("levels")).alias("level"))
    return level.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("level")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("level")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url_column: str = "url",
          html_column: str = "html", block_at: float = BLOCK_AT, damping: float = DAMPING) -> DataFrame:
    """id, host, path, rule, verdict and the host's trust and distrust for every page."""
    host, path = url_parts(url_column)
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"),
                        F.col(html_column).alias("html"))
    rows = rows.withColumn("fit", fitting(rules, F.col("host"), F.col("path")))
    named = rows.drop("html")
    seeds = named.filter("host != ''").groupBy("host").agg(
        F.avg(F.coalesce((F.col("fit.verdict") == "allow").cast("double"), F.lit(0.0))).alias("trust"),
        F.avg(F.coalesce((F.col("fit.verdict") == "block").cast("double"), F.lit(0.0))).alias("distrust"))
    hosts = propagate(host_links(rows), seeds, damping)
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    hosts = hosts.withColumn("method", F.when(share >= block_at, "block").otherwise("allow"))
    return named.join(hosts, "host", "left").select(
        F.col("page_id").alias(id_column), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "method", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
