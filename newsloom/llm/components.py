"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tables import forget, stored


def _directed(edges: DataFrame) -> DataFrame:
    """Every edge once, from its larger end ``u`` to its smaller end ``v``."""
    u, v = F.greatest("u", "v"), F.least("u", "v")
    return edges.where("u <> v").select(u.alias("u"), v.alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node with an edge; component is the smallest id it reaches.

    Alternates two star operations, each a grouped minimum and a join, so that no neighbourhood
    is ever gathered; the number of rounds grows with the logarithm of the longest path. Every
    round is written to shared storage, and the one before goes, so that the driver drops its plans."""
    now = stored(_directed(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    before = None
    while True:
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                now.select(F.col("v"), F.col("v")).distinct()
            )
        before = state
        last = now
        now = stored(_directed(_small_star(_directed(_large_star(last)))), "edges")
        forget(last)
