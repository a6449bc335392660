"""Connected components of a table of links, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import checkpointed


def least_reachable(links: DataFrame) -> DataFrame:
    """`node` and `root`, the least node reachable from it, for every node of the links (a, b).

    Each round first links every node's larger neighbours to its least neighbour, then every
    node's smaller ones; the tables shrink to stars in a logarithmic number of rounds. Each
    round is a minimum by key (reduced before its shuffle) and a join, and is checkpointed.
    """
    stars = checkpointed(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )
    seen = state(stars)
    while seen[0]:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stars_of(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), "least")
        large = large.select("a", F.col("least").alias("b")).distinct()
        small = stars_of(large)
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            small.select("a", F.col("least").alias("b"))
        )
        stars = checkpointed(small.where(F.col("a") > F.col("b")).distinct())
        now = state(stars)
        if now == seen:
            break
        seen = now
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def stars_of(edges: DataFrame) -> DataFrame:
    """The edges (a, b) with the least of a and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("lowest"))
    return edges.join(least, "a").select("a", "b", F.least("a", "lowest").alias("least"))


def state(stars: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(stars.agg(F.count("*"), F.sum(mark)).first())
