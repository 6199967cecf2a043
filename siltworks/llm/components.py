"""Distributed union-find: connected components of a table of links, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import cut, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node of its component) for every node that has a link.

    Rounds of large and small stars: every node hooks its larger neighbours, then
    its smaller ones, to the least node that it knows, until all that is left are
    stars around least nodes. Minima are partial aggregates before each exchange,
    so a hub costs a row per task; the joins on a hub are ones whose large side
    Spark can split. Each round is cut at the checkpoint folder. Null ends and
    links of a node to itself are dropped.
    """
    links = links.where(F.col(a) != F.col(b))
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _only_stars(edges):
        edges = cut(_small_star(_large_star(edges)))
        release(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node hooks to one smaller node at most, and to none if others hook to it: a further round would change nothing."""
    ends = edges.select(F.col("u").alias("w"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("w").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours hook to its least neighbour, or to itself if it has no smaller one."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return edges.join(least, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hooks to its least neighbour, and so do its other smaller ones."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    hooked = edges.join(least, F.col("u") == F.col("w")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return hooked.where("u > v").distinct()
