"""Source health as a stream (E3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(probes: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Hourly probes and failures by source; works on a stream or a table. ts is cast, as watermarks need a zoned timestamp."""
    return (
        probes.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy("source", F.window("ts", "1 hour"))
        .agg(F.count("*").alias("probes"), F.count_if("failed").alias("failures"))
        .select("source", F.col("window.start").alias("hour"), "probes", "failures")
    )


def outages(probes: DataFrame, gap: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    """source, starts, last, failures: failed probes of a source less than gap apart; works on a stream or a table.

    probes has `id` besides source, ts and failed: a probe that is sent again
    with the same id and time counts once, on a stream if it comes within
    lateness of the first. In append mode a session is returned when the
    watermark has passed its end by the gap; rows later than that are left out.
    Null times are in no session. On a large table timeline.sessions() splits
    a hot source, which this does not.
    """
    timed = probes.where("source is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    once = timed.dropDuplicatesWithinWatermark(["id", "ts"]) if probes.isStreaming else timed.dropDuplicates(["id", "ts"])
    sessions = once.where("failed").groupBy("source", F.session_window("ts", gap))
    return sessions.agg(F.min("ts").alias("starts"), F.max("ts").alias("last"), F.count("*").alias("failures")).drop("session_window")
