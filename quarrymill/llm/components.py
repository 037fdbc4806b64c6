"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge, down to a center, or is a center: then the centers are the least nodes."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    return ends.groupBy("node").agg(F.sum("up").alias("n"), F.max("down").alias("m")).where("n + m > 1").count() == 0


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) to (node, component): the least node that each linked node reaches.

    Each step is two aggregations and joins over the edges, and ends when they are stars; no group is gathered. Nodes are numbers or
    strings; null ends and self links are left out. An empty input gives an empty result.
    """
    edges = materialize(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    for _ in range(most_rounds):
        if _stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where(F.col("a") != F.col("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .where(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
        )
        edges = materialize(small.distinct(), "small")
    raise RuntimeError(f"no stars after {most_rounds} rounds")
