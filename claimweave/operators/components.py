"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators.tables import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, part) of each node of edges (a, b), part being the smallest node of its component.

    Large-star ties each node's larger neighbours to its smallest one, small-star the others;
    edges become stars in about log(n) rounds. Each round's edges are written to the shared
    folder, and only a count and a checksum reach the driver.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = _state(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        now = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        before, seen = seen, _state(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("part"))
    return stars.unionByName(stars.select(F.col("part").alias("node"), "part").distinct())
