"""What the queries share: roles of the tables in SQL, and the index of a folder's documents."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fedseek.operators.index import Index, scratch_index
from fedseek.sources.tables import table

SOURCE = "'src' || (user_id % 20)"
PROBES = f"SELECT {SOURCE} AS source, ts, coalesce(event_type = 'error', false) AS failed, event_id AS id FROM events WHERE user_id IS NOT NULL"
#: Words of a text, and the text as words with a blank before and after each.
WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
NORMAL = r"' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g') || ' '"

_indexes: dict[tuple[str, str], Index] = {}


def documents_index(spark: SparkSession, d: str) -> Index:
    """The index of a folder's documents, built once for all queries of a driver."""
    key = spark.sparkContext.applicationId, d
    if key not in _indexes:
        _indexes[key] = scratch_index(table(spark, d, "documents"), "lang", "source")
    return _indexes[key]
