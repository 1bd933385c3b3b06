"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

MAX_ROUNDS = 60


def _min_of_neighbours(both: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours. A sum by u leaves each task, so a node with many neighbours is cheap."""
    return both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.filter("v > u").join(_min_of_neighbours(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _min_of_neighbours(down)
    hooked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """edges: u, v (long). Returns u and component, the smallest id that u reaches, for each u that reaches a smaller one.

    Each round is written to the shared folder. Rounds go on until nothing changes; beyond max_rounds an error is raised.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = print_of(now)
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now)), "star")
        after = print_of(now)
        if after == before:
            return now.select("u", F.col("v").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
