"""Connected components of a graph given by its edges, as rounds of joins.

Large-star and small-star rounds: every node points its neighbours at the
least node around, until nothing changes. The number of rounds grows with the
logarithm of the graph's diameter. Each round is a written table, so a lost
executor repeats a round at most, and no node's neighbours are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import staged


def _state(edges: DataFrame) -> tuple:
    """Count and two full sums of 64-bit hashes: different edge sets don't agree in all by chance."""
    sums = [F.sum(h.cast("decimal(20,0)")) for h in (F.xxhash64("a", "b"), F.xxhash64("b", "a"))]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node it is connected with, for every node of an edge (a, b)."""
    current = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    before = None
    while (now := _state(current)) != before:
        before = now
        current = staged(_small_star(_large_star(current)), "edges")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
