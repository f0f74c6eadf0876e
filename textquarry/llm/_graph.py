"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

All steps are joins and partial aggregations over edges; only counts and sums reach the driver. Each round
is written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm._shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (u, v), u > v: link each u to the least neighbour of v, v included.

    Only nodes with a smaller neighbour are looked up, in a written table: so the join knows its size, and can
    split a node with very many edges.
    """
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).filter("m < w")
    return edges.join(written(least, "least"), F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each u and its smaller neighbours to the least of them."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long → (node, component): the least node of the component, for each node that has an edge."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    stars, before = False, None
    while not stars:
        now = written(_small_star(_large_star(now)), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stars, before = state == before, state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
