"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _with_least(edges: DataFrame, least: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Edges with the smallest neighbour ``m`` of their u.

    ``least`` is written first: beside a written table (small ones are broadcast by their known size) the neighbours of
    a hub are an ordinary skewed side, which adaptive execution splits.
    """
    used.append(written(least, "star-least"))
    return edges.join(used[-1], "u")


def _large_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _with_least(both.filter("v > u"), both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), used)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ties = _with_least(down, down.groupBy("u").agg(F.min("v").alias("m")), used).select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
    )).alias("e")).select("e.*")
    return ties.filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of the edge list (u, v: long); a component is named by its smallest node.

    Every round is written to the shared folder. The edges settle when a round changes neither their number nor the
    sum of their hashes; an edge list that has not settled after ``max_rounds`` raises.
    """
    current = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    mark = None
    for _ in range(max_rounds):
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = now
        used = [current]
        used.append(written(_large_star(current, used), "star"))
        current = written(_small_star(used[-1], used), "star")
        for table in used:
            discard(table)
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
