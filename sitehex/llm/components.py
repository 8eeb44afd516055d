"""Connected components of links, by alternating stars. Every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import staged


def _smallest(edges: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours; a hub's neighbours are reduced where they lie first."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    tied = both.join(_smallest(both), "u").where(F.col("v") > F.col("u"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node in ``links`` (a, b)."""
    edges = staged(links.where(F.col("a") != F.col("b")).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        edges = staged(_small_star(_large_star(edges)), "edges")
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == seen:
            break
        seen = (mark.n, mark.h)
    hubs = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(hubs)
