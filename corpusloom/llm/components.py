"""Connected components by alternating large and small stars, stored after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours are tied to its least neighbour. Small: the node and its smaller ones are."""
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    rows = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(back) if large else back
    least = rows.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = rows.join(least, "u")
    tied = near.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else near.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return tied.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node of edges (a, b); a < b or not, repeats allowed."""
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = None
    while True:
        # A star forest: no node is at once a centre and a leaf, and no leaf has two centres.
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == mark or not state["n"]:
            break
        mark = state
        now = stored(_stars(_stars(now, large=True), large=False))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
