"""State by batches: any split, repeated batches, hot and null keys, buckets that stay; and from a stream."""

import glob
import random

import pytest

from fedseek.operators import state
from fedseek.sources.tables import scratch_dir

SCHEMA = "k string, n long, ts long, action string"


def log(n=300, seed=1):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "a", "b", "c", None]), i, r.choice([None, r.randrange(50)]), r.choice(["add", "remove"])) for i in range(n)]


def want(rows):
    low = lambda x: (x is not None, x or 0)
    out = {}
    for r in sorted(rows, key=lambda r: (low(r[2]), low(r[1]))):
        out[r[0]] = r
    return sorted(out.values(), key=repr)


def files(path):
    return {f: open(f, "rb").read() for f in glob.glob(f"{path.removeprefix('file:')}/bucket=*/*.parquet")}


@pytest.mark.parametrize("split", [1, 2, 5])
def test_any_split_and_repeated_batches(spark, split):
    rows, path = log(), f"{scratch_dir(spark)}/s"
    order = list(range(split)) + [0]
    random.Random(split).shuffle(order)
    for b in order:
        state.merge_last_rows(spark.createDataFrame(rows[b::split], SCHEMA).repartition(3), path, ["k"], ["ts", "n"], 4)
    assert sorted((tuple(r) for r in state.kept_rows(spark, path).select("k", "n", "ts", "action").collect()), key=repr) == want(rows)


def test_other_buckets_stay(spark):
    path = f"{scratch_dir(spark)}/s"
    state.merge_last_rows(spark.createDataFrame([(f"k{i}", i, i, "add") for i in range(40)], SCHEMA), path, ["k"], ["ts", "n"], 8)
    before = files(path)
    state.merge_last_rows(spark.createDataFrame([("k3", 99, 99, "remove")], SCHEMA), path, ["k"], ["ts", "n"], 8)
    after = files(path)
    assert len(before) == 8 and len(set(before.items()) & set(after.items())) == 7
    state.merge_last_rows(spark.createDataFrame([], SCHEMA), path, ["k"], ["ts", "n"], 8)
    assert files(path) == after
    assert state.kept_rows(spark, path).where("k = 'k3'").first().n == 99


def test_from_a_stream(spark):
    rows, at = log(120, 5), scratch_dir(spark)
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    for _ in range(2):  # a restart has nothing left to do
        state.keep_last_rows(stream, f"{at}/state", ["k"], ["ts", "n"], f"{at}/checkpoint", 4).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((tuple(r) for r in state.kept_rows(spark, f"{at}/state").select("k", "n", "ts", "action").collect()), key=repr) == want(rows)
    rows2 = log(40, 6)
    spark.createDataFrame(rows2, SCHEMA).write.mode("append").parquet(f"{at}/in")
    state.keep_last_rows(stream, f"{at}/state", ["k"], ["ts", "n"], f"{at}/checkpoint", 4).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((tuple(r) for r in state.kept_rows(spark, f"{at}/state").select("k", "n", "ts", "action").collect()), key=repr) == want(rows + rows2)
