"""A table in order, dealt into blocks of even size whatever its keys are.

What a row needs from the rows of its key before it is found in two steps: in
its block, and from the last blocks before it, of which only one row for each
key counts. So a key with a third of all rows is worked on by a third of the
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedseek.sources.tables import written

ROWS = 1_000_000


def in_blocks(df: DataFrame, order: list[Column], rows: int = ROWS) -> DataFrame:
    """df with block and pos: its rows sorted by order, about `rows` to a block; pos grows from row to row.

    Rows equal in all of order may be in several blocks, so the rows of one key
    are as many blocks as they need. Columns block and pos must not exist yet.
    """
    spark = df.sparkSession
    df = written(df.withColumn("pos", F.monotonically_increasing_id()))
    n = df.count()
    blocks = max(-(-n // rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000)), 1)
    order = [*order, F.asc("pos")]
    dealt = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    return written(dealt.withColumn("block", F.shiftright("pos", 33)))


def last_before(rows: DataFrame, key: str, value: Column, name: str, own: bool = False) -> DataFrame:
    """rows, in blocks sorted by key first, with the last value that is not null in the rows of their key before them; with `own`, their own value counts too. key is not null.

    A window over a key has one row for each block that has the key.
    """
    value_name, kept = f"_{name}_here", f"_{name}_kept"
    rows = rows.withColumn(value_name, value)
    here = Window.partitionBy("block", key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    ends = rows.groupBy("block", key).agg(F.max_by(value_name, F.when(F.col(value_name).isNotNull(), F.col("pos"))).alias("_end"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = written(ends.withColumn(kept, F.last("_end", ignorenulls=True).over(before)).drop("_end"))
    found = F.coalesce(F.last(value_name, ignorenulls=True).over(here), F.col(kept))
    return rows.join(ends, ["block", key], "left").withColumn(name, found).drop(value_name, kept)


def running_sums(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """rows, in blocks sorted by key first, with the sum of each of some whole numbers, by name, over the rows of their key up to them. key is not null."""
    rows = rows.withColumns({f"_{n}_here": v for n, v in values.items()})
    here = Window.partitionBy("block", key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("block", key).agg(*(F.sum(f"_{n}_here").alias(f"_{n}_end") for n in values))
    ends = written(ends.select("block", key, *(F.sum(f"_{n}_end").over(before).alias(f"_{n}_kept") for n in values)))
    sums = {n: F.sum(f"_{n}_here").over(here) + F.coalesce(f"_{n}_kept", F.lit(0)) for n in values}
    return rows.join(ends, ["block", key], "left").withColumns(sums).drop(*(f"_{n}_{x}" for n in values for x in ("here", "kept")))


def running_sum(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """running_sums of one."""
    return running_sums(rows, key, {name: value})
