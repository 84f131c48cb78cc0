import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from fedseek.llm.common import scratch, stored
from fedseek.llm.graph import components


def there(t):
    return os.path.exists(t.stored_at.removeprefix("file:"))


def test_scratch_deletes_only_its_threads_tables(spark):
    own, others, go, done = {}, {}, threading.Event(), threading.Event()

    def other():
        with scratch(spark, []):
            others["t"] = stored(spark.range(3))
            go.set()
            done.wait(60)
            others["there"] = there(others["t"])

    thread = threading.Thread(target=other)
    thread.start()
    go.wait(60)
    with scratch(spark, keep := []):
        own["gone"] = stored(spark.range(2))
        keep.append(stored(spark.range(4)))
    assert not there(own["gone"]) and there(keep[0]) and keep[0].count() == 4
    done.set()
    thread.join()
    assert others["there"] and not there(others["t"])


def test_scratch_deletes_after_an_error(spark):
    made = []
    with pytest.raises(ZeroDivisionError), scratch(spark, []):
        made.append(stored(spark.range(2)))
        with scratch(spark, made):
            made.append(stored(spark.range(2)))
        assert there(made[1])
        1 / 0  # noqa: B018
    assert not there(made[0]) and not there(made[1])


def test_components_by_plain_search(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5), (7, 5), (5, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {x.u: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_a_star_is_split_by_the_skew_join(spark):
    """A join of edges with a stored aggregate, as in components, with thresholds so low that the star is skewed."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = stored(spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("u"), (F.col("id") + 10**6).alias("v")).repartition(16))
        least = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
        joined = edges.join(least, "u")
        assert joined.count() == 200_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
