"""Connected components by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .skew import heavy_keys, salted_join


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def _large_star(edges: DataFrame, least: int, total: int) -> DataFrame:
    """Every neighbour above ``u`` is tied to the smallest node around ``u``."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both.groupBy("u").agg(F.min("v").alias("near"), F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(around, "u", least=least, weight="n", total=2 * total)
    lowest = around.select("u", F.least("u", "near").alias("m"))
    return salted_join(both.where("v > u"), lowest, "u", heavy=heavy, spread_by=["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, least: int, total: int) -> DataFrame:
    """``u`` and its smaller neighbours are tied to the smallest of them."""
    around = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(around, "u", least=least, weight="n", total=total)
    lowest = around.select("u", "m")
    moved = salted_join(edges, lowest, "u", heavy=heavy, spread_by=["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, heavy_rows: int = 200_000) -> DataFrame:
    """Component of every node that has an edge to another node: columns ``node, root``.

    ``root`` is the smallest node of the component. Nulls and self-loops tie nothing. Each round
    is two shuffles with partial aggregation; rounds grow with the logarithm of the longest chain.
    Only a row count and a checksum reach the driver. Hubs are salted (``heavy_rows``).
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    now = cut(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    mark = _fingerprint(now)
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now, heavy_rows, mark[0]), heavy_rows, mark[0]))
        new = _fingerprint(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
