"""Keyword search: match, skip dead sources, rank, bound (A1, A2, A5-A7, E1, E2).

The score is the number of occurrences of the keyword, then the shorter text,
then the id: a total order, chosen by us as none is published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedseek.functions.text import contains_keyword, has_token, occurrences


def matching(documents: DataFrame, keyword: str) -> DataFrame:
    """doc_id, source, n_chars, tf of documents with the keyword; the text goes no further."""
    return documents.where(contains_keyword(F.col("text"), keyword)).select(
        "doc_id", "source", "n_chars", occurrences(F.col("text"), keyword).alias("tf")
    )


ORDER = (F.desc_nulls_last, "tf"), (F.asc_nulls_last, "n_chars"), (F.asc_nulls_last, "doc_id")


def order() -> list:
    return [f(c) for f, c in ORDER]


def top(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits with their rank. Limits first, so that only k rows are numbered."""
    best = hits.orderBy(*order()).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order())))


def top_per_source(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("source").orderBy(*order())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hits_by_source(documents: DataFrame, keyword: str) -> DataFrame:
    """One scan answers for all sources in parallel (A1): hits and occurrences of each."""
    return (
        documents.groupBy("source")
        .agg(
            F.count_if(contains_keyword(F.col("text"), keyword)).alias("hits"),
            F.sum(occurrences(F.col("text"), keyword)).alias("occurrences"),
            F.count("*").alias("items"),
        )
    )


def with_tag(items: DataFrame, column: str, *tags: str) -> DataFrame:
    """Rows whose column has one of the tags as a whole token, such as 4k or 2160p (A6)."""
    return items.where(has_token(F.col(column), *tags))


def collapse(documents: DataFrame) -> DataFrame:
    """Exact copies as one row (E1): text digest, first id, copies, sources in order. Null texts form no group."""
    return (
        documents.where(F.col("text").isNotNull())
        .groupBy(F.md5("text").alias("digest"))
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.count("*").alias("copies"),
            F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
        )
    )
