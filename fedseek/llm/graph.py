"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedseek.llm.common import dropped, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """u, component: the smallest node that u reaches, for every node of links (u, v) but the smallest of each component.

    Alternates large-star and small-star steps until nothing changes. Each
    step joins edges with the least neighbour of each node, which is a stored
    table: the join then deals both sides anew, so that a node with very many
    links is split by the skew join, as it could not be behind an aggregate.
    """
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct())
        dropped(least, edges)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u != v").distinct())
        dropped(least, large)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select("u", F.col("v").alias("component"))
