"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.sources.scratch import stored


def components(links: DataFrame, scratch: str | None = None) -> DataFrame:
    """``u``, ``v``: every linked node but the least of its component, with that least one.

    ``links`` has two columns of one ordered type and may hold repeats, loops and both directions. Each
    round hangs a node's larger neighbours, and then its smaller ones, onto the least around; long
    chains halve, so the rounds are logarithmic. Minima are aggregated before they move, and the
    rows of a hub are joined, never gathered. Each round is stored; an empty table gives an empty one.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges = stored(edges, "links", scratch)
    while not _is_settled(edges):
        edges = stored(_small_star(_large_star(edges)), "links", scratch)
    return edges


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return seen.filter("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung onto the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung onto the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
