"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over rows (u, v); every node is hung under the smallest node that it knows."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    hung = both.join(low, "u")
    if large:
        moved = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        own = low.where(F.col("u") != F.col("low")).select("u", F.col("low").alias("v"))
        moved = hung.where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(own)
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link table (u, v); root is the smallest node of its component.

    Each round is cut with a table in the shared folder, so a lost executor
    costs one round; rounds that are no longer read are deleted. Nulls are dropped, loops and repeated links don't matter,
    an empty table gives an empty result. Ends when a round changes nothing.
    """
    edges = write_table(links.select("u", "v").dropna().where("u != v").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark, old = seen, edges
        edges = write_table(_star(_star(old, True), False), "stars")
        drop_written(old)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
