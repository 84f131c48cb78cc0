"""Outages as a stream: the closed sessions are the batch's; copies count once; late rows, nulls."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fedseek.operators import timeline
from fedseek.sources.tables import scratch_dir
from fedseek.streaming.health import outages

T = dt.datetime(2024, 1, 1)
SCHEMA = "id long, source string, ts timestamp_ntz, failed boolean"


def probes(n=400, seed=3):
    r = random.Random(seed)
    minutes = sorted(r.randrange(0, 20_000) for _ in range(n))
    return [(i, r.choice(["hot", "hot", "a", "b", None]), T + dt.timedelta(minutes=m), r.random() < 0.4) for i, m in enumerate(minutes)] + [(n, "a", None, True)]


def rows(df):
    return sorted((r.source, r.starts, r.last, r.failures) for r in df.withColumn("starts", F.col("starts").cast("timestamp_ntz")).withColumn("last", F.col("last").cast("timestamp_ntz")).collect())


def test_table_is_as_by_blocks(spark):
    df = spark.createDataFrame(probes(), SCHEMA)
    own = timeline.sessions(df.where("failed"), "source", "ts", 6 * 3600, 50).select("source", "starts", "last", F.col("events").alias("failures"))
    assert rows(outages(df.unionByName(df))) == rows(own) and own.count() > 20


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_has_the_closed_sessions(spark, seed):
    """Rows come in files by hour, shuffled within two hours, each third one twice; a watermark of four hours is enough."""
    at, all_rows = scratch_dir(spark), probes(seed=seed)
    r = random.Random(seed)
    kept = [x for x in all_rows if x[2] is not None]
    late = sorted(kept + kept[::3], key=lambda x: x[2] + dt.timedelta(minutes=r.randrange(120)))
    size = 60
    for n, i in enumerate(range(0, len(late), size)):
        spark.createDataFrame(late[i : i + size], SCHEMA).coalesce(1).write.parquet(f"{at}/in/f{n:03}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{at}/in/*")
    out = outages(stream, "6 hours", "4 hours").writeStream.option("checkpointLocation", f"{at}/c").format("parquet").option("path", f"{at}/out").outputMode("append")
    out.trigger(availableNow=True).start().awaitTermination(200)
    got = rows(spark.read.parquet(f"{at}/out"))
    every = rows(outages(spark.createDataFrame(all_rows, SCHEMA)))
    end = max(x[2] for x in kept)
    closed = [x for x in every if x[2] + dt.timedelta(hours=6) < end - dt.timedelta(hours=4)]
    assert set(closed) <= set(got) <= set(every) and len(got) == len(set(got)) and len(closed) > 20
