"""Anonymous statistics (A12). Keywords and user columns can't pass, as only listed columns do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that may leave the device.
ALLOWED = ("day", "event_type")


def anonymous(events: DataFrame) -> DataFrame:
    """day, event_type, n: starts with the allow-list projection."""
    kept = events.select(F.to_date("ts").alias("day"), "event_type").select(*ALLOWED)
    return kept.groupBy(*ALLOWED).agg(F.count("*").alias("n"))
