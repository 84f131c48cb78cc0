"""What several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the characters that separate words.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; a local one only where none is set and all is on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"


#: Paths that stored() has written inside the innermost scratch() of this thread, and nothing has deleted.
_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors, and is computed once. It goes with the driver, if nothing deletes it before."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if (made := _made.get()) is not None:
        made.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)
    files.cancelDeleteOnExit(at)
    if path in (made := _made.get() or []):
        made.remove(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of stored(); only for those whose every reader has itself been stored."""
    for t in tables:
        _delete(t.sparkSession, t.stored_at)


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Deletes at the end, an error's included, what stored() wrote inside in this thread, but for the tables that were put into keep."""
    outer, own = _made.get(), []
    token = _made.set(own)
    try:
        yield
    finally:
        kept = {t.stored_at for t in keep}
        for path in [p for p in own if p not in kept]:
            _delete(spark, path)
        _made.reset(token)
        if outer is not None:
            outer += own


def ordered(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """df in order: block, of about `rows` rows, and pos, the place in the block from 0 on; stored.

    Rows that are equal in all of order may stand in any order and in several
    blocks, so no key is too frequent for a task.
    """
    spark = df.sparkSession
    df = stored(df.withColumn("pos", F.monotonically_increasing_id()))
    n = df.count()
    blocks = max(-(-n // rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000)), 1)
    order = [*order, F.asc("pos")]
    placed = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    out = stored(placed.withColumn("block", F.shiftright("pos", 33)).withColumn("pos", F.col("pos").bitwiseAND((1 << 33) - 1)))
    dropped(df)
    return out


def before_blocks(rows: DataFrame, per: str = "block") -> tuple[DataFrame, int]:
    """block, before: rows in all blocks before it; number of rows. The driver sees a number for each block."""
    before, total = [], 0
    for block, n in rows.groupBy(per).count().orderBy(per).collect():
        before.append((block, total))
        total += n
    return rows.sparkSession.createDataFrame(before, f"{per} bigint, before bigint"), total


def unit_random(*parts: Column) -> Column:
    """A double in [0, 1) that depends on parts only, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def free_name(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores in front as keep it off df's columns, which Spark compares without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out
