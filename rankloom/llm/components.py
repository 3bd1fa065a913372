"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import store


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that is not its own root, stored: the root is the smallest node of its
    component.

    Alternates two rewrites of the links until all are stars: every node passes its smallest neighbour to its larger
    neighbours, then to its smaller ones. The number of rounds grows with the logarithm of the longest path; links that are
    stars already take none. Each round is written to the shared folder. Smallest neighbours are aggregated before they
    are shuffled and joined back, so a node with very many links is a join key, which Spark splits.
    """
    now = store(_ordered(links.select("u", "v")))
    while not _stars(now):
        now = store(_ordered(_to_smaller(_to_larger(now))))
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _stars(links: DataFrame) -> bool:
    """Whether no larger end has two links or is a smaller end too."""
    ends = links.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("n")).union(links.select("u", F.lit(1), F.lit(0)))
    seen = ends.groupBy("x").agg(F.max("low").alias("low"), F.sum("n").alias("n"))
    return seen.filter((F.col("n") > 1) | ((F.col("low") == 1) & (F.col("n") > 0))).isEmpty()


def _ordered(links: DataFrame) -> DataFrame:
    low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    return links.filter("u != v").select(low, high).distinct()


def _to_larger(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v"), F.col("u"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v")


def _to_smaller(links: DataFrame) -> DataFrame:
    """``links`` lead from the smaller ``u`` to the larger ``v``; all that a node points down to meets at its smallest."""
    links = links.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    least = links.groupBy("v").agg(F.min("u").alias("m"))
    moved = links.join(least, "v").filter("u != m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.union(least.select(F.col("m").alias("u"), "v"))
