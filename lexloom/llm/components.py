"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._common import forget, spread_join, written


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of u goes to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0").select("u", F.least("u", "m").alias("m"), "n")
    return spread_join(both.where(F.col("v") > F.col("u")), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """u and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = spread_join(down, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(id, component) for the ends of edges (u, v), of any type with an order; component
    is the smallest id that can be reached. Each round is written to the shared folder;
    the rounds are at most in the order of the square of the logarithm of the largest
    component. A node with many neighbours is dealt to several tasks."""
    now = written(edges.select("u", "v").where("u <> v").distinct(), name)
    seen, total = None, now.count()
    while True:
        after = written(_small_star(_large_star(now, total), total).distinct(), name)
        mark = tuple(after.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        forget(now)
        now, total = after, mark[0]
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
