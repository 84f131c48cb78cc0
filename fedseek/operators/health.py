"""Source health (A7, A8, A14, A15).

Rules of ours: a source is dead when at least dead_percent of its probes
failed; a source without probes is not dead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEAD_PERCENT = 22
#: Dead sources that are written into the plan.
LISTED = 1000


def by_source(probes: DataFrame, dead_percent: int = DEAD_PERCENT) -> DataFrame:
    """source, probes, failures, dead. Integer arithmetic, so that engines agree."""
    return (
        probes.groupBy("source")
        .agg(F.count("*").alias("probes"), F.count_if("failed").alias("failures"))
        .withColumn("dead", F.col("failures") * 100 >= F.col("probes") * dead_percent)
    )


def by_day(probes: DataFrame) -> DataFrame:
    return (
        probes.groupBy("source", F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("probes"), F.count_if("failed").alias("failures"))
    )


def skip_dead(items: DataFrame, health: DataFrame) -> DataFrame:
    """items whose source is not dead; sources never probed, and null sources, stay.

    Up to LISTED dead sources become a literal list, which filters below any
    work on the text and prunes files where items are partitioned by source;
    more are an anti join.
    """
    dead = health.where(F.col("dead") & F.col("source").isNotNull()).select("source")
    listed = [r.source for r in dead.limit(LISTED + 1).collect()]
    if len(listed) > LISTED:
        return items.join(dead, "source", "left_anti")
    return items.where(F.col("source").isNull() | ~F.col("source").isin(listed)) if listed else items


def report(probes: DataFrame, dead_percent: int = DEAD_PERCENT) -> DataFrame:
    """Health evidence: by_source with permille of failures and the last probe."""
    return (
        probes.groupBy("source")
        .agg(F.count("*").alias("probes"), F.count_if("failed").alias("failures"), F.max("ts").alias("last_probe"))
        .withColumn("dead", F.col("failures") * 100 >= F.col("probes") * dead_percent)
        .withColumn("failure_permille", F.expr("failures * 1000 div probes"))
    )


def source_dimension(probes: DataFrame) -> DataFrame:
    """The changing set of sources (A14): first and last day seen, and days active."""
    return probes.groupBy("source").agg(
        F.to_date(F.min("ts")).alias("first_day"),
        F.to_date(F.max("ts")).alias("last_day"),
        F.count_distinct(F.to_date("ts")).alias("days_active"),
    )
