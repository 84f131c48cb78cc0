"""Keyed local state: favourites and search history (A10, A11, A16)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Folders of a kept state.
BUCKETS = 64


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of an append-only log; ties in order are settled by later columns of order."""
    w = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def favourites(log: DataFrame, key: list[str], order: list[str], action: str, add: str) -> DataFrame:
    """Keys whose last action is add."""
    return latest(log, key, order).where(F.col(action) == add)


def history(log: DataFrame, key: list[str], order: list[str], keep: int) -> DataFrame:
    """The newest keep rows of each key; repeats stay, as nothing says otherwise."""
    w = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return log.withColumn("position", F.row_number().over(w)).where(F.col("position") <= keep)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log. Columns may be new or missing; files that are there stay as they are."""
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log whose files were written by different versions: missing columns read as null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def last_rows(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """As latest(), by an aggregate: what a task has seen of a key is one row before it moves, so no key is too frequent."""
    row = F.max_by(F.struct(*log.columns), F.struct(*order)).alias("row")
    return log.groupBy(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)]).agg(row).select("row.*")


def merge_last_rows(batch: DataFrame, path: str, key: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Brings the rows of a batch into the state at path, which has the last row of each key (A10, A16).

    The state is in folders by `bucket`, a hash of the key; those that the batch
    has keys of are written anew, others stay as they are. The last row by
    order, nulls lowest, is the same in whatever batches rows come, and however
    often, as long as order tells rows apart; so a batch that is run again after
    a failure changes nothing. A null key is a key. Columns must be the same in
    all batches, and none be named bucket.
    """
    spark = batch.sparkSession
    rows = last_rows(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
    try:
        held = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched))
    except AnalysisException:  # nothing there yet
        held = rows.limit(0)
    if touched:
        merged = last_rows(held.unionByName(rows), key, order)
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    rows.unpersist()


def kept_rows(spark: SparkSession, path: str) -> DataFrame:
    """The state at path."""
    return spark.read.parquet(path).drop("bucket")


def keep_last_rows(stream: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer that merges each micro-batch of a stream into the state at path."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: merge_last_rows(batch, path, key, order, buckets))
