"""Exact ranks without a task that holds a whole group.

A rank by hash is cut at the hash's first digits: rows are ranked within (group, prefix), and the counts of the
smaller prefixes of the group are added. So a label with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(rows: DataFrame, group: list[str], order: Column, *ties: str, digits: int = 2) -> DataFrame:
    """Add rank (from 1) and group_size; order: a hex string, spread evenly (a hash); ties: columns that break ties."""
    cell = [*group, "_prefix"]
    rows = rows.withColumn("_order", order).withColumn("_prefix", F.substring("_order", 1, digits))
    local = F.row_number().over(Window.partitionBy(*cell).orderBy("_order", *ties))
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    by_group = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(by_group.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*cell, before.alias("_before"), F.sum("_n").over(by_group).alias("group_size"))
    ranked = rows.withColumn("_local", local).alias("r")
    sizes = sizes.select(*(F.col(c).alias(f"_s_{i}") for i, c in enumerate(cell)), "_before", "group_size")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"_s_{i}")) for i, c in enumerate(cell)]
    joined = ranked.join(sizes, reduce(and_, same))
    return joined.select("r.*", (F.col("_before") + F.col("_local")).alias("rank"), "group_size").drop("_order", "_prefix", "_local")


def global_rank(rows: DataFrame, order: Column, *ties: str) -> DataFrame:
    """hash_rank over all rows as one group."""
    return hash_rank(rows.withColumn("_all", F.lit(0)), ["_all"], order, *ties).drop("_all")
