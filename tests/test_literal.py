"""Rows that the tables can't offer: look-alikes, nulls, ties, broken inputs, late events."""

import datetime as dt

from pyspark.sql import functions as F

from fedseek.functions.text import has_token, occurrences
from fedseek.operators import health, search, state, telemetry
from fedseek.sources.tables import scratch_dir, tolerant, unread, write_bytes
from fedseek.streaming.health import hourly


def test_tag_is_a_whole_token(spark):
    df = spark.createDataFrame([(1, "Film 4K HDR"), (2, "14k gold"), (3, None), (4, "x.2160p"), (5, "")], "id long, title string")
    assert [r.id for r in search.with_tag(df, "title", "4k", "2160p").orderBy("id").collect()] == [1, 4]
    assert df.where(has_token(F.col("title"), "4k")).count() == 1


def test_occurrences(spark):
    df = spark.createDataFrame([("aXaxa",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(occurrences(F.col("t"), "ax")).collect()] == [2, 0, 0]


def test_unobserved_and_null_sources_stay(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, source string")
    h = spark.createDataFrame([("a", True), ("b", False)], "source string, dead boolean")
    assert sorted(r.id for r in health.skip_dead(items, h).collect()) == [2, 3, 4]


def test_equal_rank_is_settled_by_id(spark):
    hits = spark.createDataFrame([(3, "s", 5, 1), (1, "s", 5, 1), (2, "s", 5, 1)], "doc_id long, source string, n_chars long, tf long")
    assert [r.doc_id for r in search.top(hits, 2).orderBy("rank").collect()] == [1, 2]


def test_state_log(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, 1, t, "add"), (1, 2, t, "remove"), (2, 3, t, "remove"), (2, 4, t, "add")], "k long, n long, ts timestamp_ntz, action string")
    assert [r.k for r in state.favourites(log, ["k"], ["ts", "n"], "action", "add").collect()] == [2]


def test_old_and_new_schema(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/log/v=1")
    spark.range(2, 4).withColumn("note", F.lit("x")).write.parquet(f"{tmp_path}/log/v=2")
    df = state.read_log(spark, f"{tmp_path}/log")
    assert df.count() == 4 and df.where("note is null").count() == 2


def test_one_broken_source(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/good")
    (tmp_path / "good" / "bad.parquet").write_bytes(b"junk")
    df, lost = tolerant(spark, [f"{tmp_path}/good", f"{tmp_path}/absent"], "id long")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    assert lost == [f"{tmp_path}/absent"]


def test_telemetry_columns(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, "view", "secret")], "user_id long, ts timestamp_ntz, event_type string, keyword string")
    assert set(telemetry.anonymous(df).columns) <= set(telemetry.ALLOWED) | {"n"}


def test_stream_drops_what_is_too_late(spark, tmp_path):
    rows = lambda *h: spark.createDataFrame([("a", dt.datetime(2024, 1, 1, x), True) for x in h], "source string, ts timestamp_ntz, failed boolean")
    src = str(tmp_path / "in")
    rows(1, 9).coalesce(1).write.mode("append").parquet(src)

    def drain():
        stream = spark.readStream.schema("source string, ts timestamp_ntz, failed boolean").parquet(src)
        q = hourly(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()

    drain()
    rows(2, 12).coalesce(1).write.mode("append").parquet(src)  # hour 2 is beyond the watermark of hour 9
    drain()
    got = sorted(r.hour.hour for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [1, 9]


def test_files_that_gave_no_row_are_named(spark):
    path = scratch_dir(spark)
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, t string")
    docs.repartition(3).write.parquet(f"{path}/a b")
    docs.limit(0).write.parquet(f"{path}/none")
    docs.write.parquet(f"{path}/good")
    write_bytes(spark, f"{path}/a b/part-broken.parquet", b"not a table")
    paths = [f"{path}/{x}" for x in ("a b", "none", "good", "absent")]
    found, lost = tolerant(spark, paths, docs.schema)
    assert found.count() == 40 and lost == paths[3:]
    files = [(r.path.rpartition("/")[2][:11], r.length) for r in unread(spark, paths, docs.schema).collect() if "/none/" not in r.path]
    assert files == [("part-broken", 11)]
    assert unread(spark, paths[3:], docs.schema).collect() == unread(spark, [], docs.schema).collect() == []


def test_scratch_folders_go_with_the_driver(spark):
    at = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(at) and files.cancelDeleteOnExit(at)
    files.deleteOnExit(at)


def test_more_dead_sources_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(health, "LISTED", 3)
    items = spark.createDataFrame([(i, None if i == 9 else f"s{i}") for i in range(10)], "id long, source string")
    h = spark.createDataFrame([(f"s{i}", i < 5) for i in range(8)] + [(None, True)], "source string, dead boolean")
    assert sorted(r.id for r in health.skip_dead(items, h).collect()) == [5, 6, 7, 8, 9]
