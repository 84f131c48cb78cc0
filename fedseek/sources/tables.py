"""Readers, and the bindings of the roles to the fixture tables.

The bindings are ours: an item is a row of documents or pages, a health probe
is an event, and an event belongs to source 'src' || user_id % 20.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fedseek.functions.text import page_title

SOURCES = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares (spark.checkpoint.dir), deleted when the driver ends; a local one only where none is set and all is on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    path = f"{base.rstrip('/')}/s-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)  # with the driver
    return path


def written(df: DataFrame, path: str | None = None, *parts: str) -> DataFrame:
    """df written to path, a new one by default, in folders by parts, and read again: computed once, and its size known to the planner."""
    spark = df.sparkSession
    path = path or f"{scratch_dir(spark)}/t"
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(content))
    out.close()


def tolerant(spark: SparkSession, paths: Iterable[str], schema: str | StructType) -> tuple[DataFrame, list[str]]:
    """What can be read of several inputs, and the paths that could not be resolved (A9).

    A path that does not resolve is left out and named in the list; a file that
    turns out corrupt while it is read is skipped by the reader. Each row has
    its file in `input`, so lost files show as absent. With no readable path
    the frame is empty.
    """
    kept, lost = [], []
    for path in paths:
        try:
            part = (
                spark.read.schema(schema)
                .option("ignoreCorruptFiles", "true")
                .option("ignoreMissingFiles", "true")
                .parquet(path)
                .withColumn("input", F.input_file_name())
            )
        except AnalysisException:
            lost.append(path)
        else:
            kept.append(part)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    empty = spark.createDataFrame([], StructType([*schema.fields, StructField("input", StringType())]))
    return reduce(DataFrame.unionByName, kept, empty), lost


def unread(spark: SparkSession, paths: Iterable[str], schema: str | StructType) -> DataFrame:
    """path, length of the files of inputs of which tolerant() returns no row: corrupt ones, and those that hold none (A9).

    No content is read: files are listed, and the other side opens footers only,
    so a file that breaks later, in its pages, is not among them. Paths that do
    not resolve are in tolerant()'s list instead.
    """
    listed, seen = [], []
    for path in paths:
        try:
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
            rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)
        except AnalysisException:
            continue
        listed.append(files.select(F.col("_metadata.file_path").alias("path"), "length"))
        seen.append(rows.select(F.col("_metadata.file_path").alias("path")))
    if not listed:
        return spark.createDataFrame([], "path string, length bigint")
    return reduce(DataFrame.unionByName, listed).join(reduce(DataFrame.unionByName, seen).distinct(), "path", "left_anti")


def document_items(documents: DataFrame) -> DataFrame:
    """documents in the common result form (A3): origin, item_id, source, title, body, link."""
    return documents.select(
        F.lit("documents").alias("origin"),
        F.col("doc_id").alias("item_id"),
        "source",
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("body"),
        F.lit(None).cast("string").alias("link"),
    )


def page_items(pages: DataFrame) -> DataFrame:
    """pages in the common result form (A3); the source is the host and the link is the url, passed through as text."""
    return pages.select(
        F.lit("pages").alias("origin"),
        F.col("page_id").alias("item_id"),
        F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1).alias("source"),
        page_title(F.col("html")).alias("title"),
        F.col("html").alias("body"),
        F.col("url").alias("link"),
    )


def unified_items(*parts: DataFrame) -> DataFrame:
    """Bag union of parts in the common form (A4): repeated rows stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def event_source() -> Column:
    """The source of an event, by its user_id; null without one."""
    return F.concat(F.lit("src"), (F.col("user_id") % SOURCES).cast("string"))


def probes(events: DataFrame, *more: Column) -> DataFrame:
    """Health probes: source, ts, failed, and more columns of the event. A null user has no source and is left out."""
    return events.where(F.col("user_id").isNotNull()).select(event_source().alias("source"), "ts", F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("failed"), *more)
