"""Joins and sums along time: as of a moment, sessions, periods, overlaps, trailing windows (A7, A8, A14).

A source with very many rows is split by time or by blocks of the sorted rows;
no join here is a product of a source's rows, and none compares times without a
key. Times are compared as they stand; a time with a zone counts by the
session's zone where it is dealt into hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedseek.operators.blocks import ROWS, in_blocks, last_before, running_sum, running_sums
from fedseek.sources.tables import written


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall clock that showed ts."""
    second = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000 + second


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, known: str, values: list[str], tie: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """left with `values` of the last row of right that has its key and whose `known` is not after its ts.

    Of rows of right that are known at the same time the last by `tie`, nulls
    first, counts. All rows of left stay, repeated ones too; values are null
    where nothing is known yet, and where key or ts is null. Rows of right
    without key or known are left out. Left must not have columns named as in
    `values`.

    Both sides are one table sorted by (key, time, side), in which a value goes
    on to the rows after it: rows are moved twice and never multiplied.
    """
    if clash := {c.lower() for c in left.columns} & {v.lower() for v in values}:
        raise ValueError(f"left has columns {sorted(clash)}")
    r = right.where(F.col(key).isNotNull() & F.col(known).isNotNull()).select(
        F.col(key).alias("key"), F.col(known).alias("at"), F.lit(0).alias("side"), F.struct(*(tie or values)).alias("tie"), F.struct(*values).alias("value")
    )
    none = {f.name: F.lit(None).cast(f.dataType) for f in r.schema.fields}
    in_time = F.col(key).isNotNull() & F.col(ts).isNotNull()
    both = left.where(in_time).select(F.col(key).alias("key"), F.col(ts).alias("at"), F.lit(1).alias("side"), none["tie"].alias("tie"), none["value"].alias("value"), F.struct(*left.columns).alias("row"))
    out_of_time = left.where(~in_time)
    r = r.withColumn("row", F.lit(None).cast(both.schema["row"].dataType))
    sorted_rows = in_blocks(both.unionByName(r), [F.asc("key"), F.asc("at"), F.asc("side"), F.asc_nulls_first("tie")], rows)
    found = last_before(sorted_rows, "key", F.col("value"), "known_value").where("side = 1").select("row.*", *(F.col(f"known_value.{v}").alias(v) for v in values))
    return found.unionByName(out_of_time.select("*", *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values)))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, rows: int = ROWS) -> DataFrame:
    """key, session (1, 2, ... by time), starts, last, events: events of a key less than the gap apart. Null keys and times are in no session."""
    order = [F.asc("key"), F.asc("at")]
    timed = events.select(F.col(key).alias("key"), F.col(ts).alias("at")).where("key is not null and at is not null")
    timed = last_before(in_blocks(timed, order, rows), "key", F.col("at"), "earlier")
    new = F.col("earlier").isNull() | (micros(F.col("at")) - micros(F.col("earlier")) >= gap_seconds * 1_000_000)
    numbered = running_sum(timed, "key", new.cast("long"), "session")
    # first by block, so that a session of very many events is not one task's
    out = numbered.groupBy("key", "session").agg(F.min("at").alias("starts"), F.max("at").alias("last"), F.count("*").alias("events"))
    return out.withColumnRenamed("key", key)


def periods(days: DataFrame, key: str, day: str, state: str) -> DataFrame:
    """key, state, starts, ends (the day after the last), days: stretches of consecutive days of one state, of one row for each key and day. A day without a row ends a period. Null keys and days are left out; a null state is a state."""
    w = Window.partitionBy(key, state).orderBy(day)
    kept = days.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(key, day, state)
    island = F.date_sub(F.col(day), F.row_number().over(w))
    return kept.withColumn("_island", island).groupBy(key, state, "_island").agg(F.min(day).alias("starts"), F.date_add(F.max(day), 1).alias("ends"), F.count("*").alias("days")).drop("_island")


def _hours(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)


def overlaps(left: DataFrame, right: DataFrame, key: str, bin_hours: int = 24) -> DataFrame:
    """left and right as structs, starts and ends of what they share: pairs of one key whose [starts, ends) overlap.

    Both have key, starts and ends. An interval that is empty, reversed or has a
    null overlaps nothing, nor does one without key. Repeated rows pair each by
    itself. An interval stands in each bin of time that it touches, and a pair
    is taken in the bin where the later of the two starts, so once. A wide bin
    compares more, a narrow one copies long intervals more often.
    """

    def binned(df: DataFrame, side: str) -> DataFrame:
        first, last = (F.floor(_hours(F.col(c)) / bin_hours) for c in ("starts", "ends"))
        kept = df.where(F.col(key).isNotNull() & (F.col("starts") < F.col("ends")))
        return kept.select(F.col(key).alias("key"), F.struct(*df.columns).alias(side), first.alias(f"{side}_first"), F.explode(F.sequence(first, last)).alias("bin"))

    pairs = binned(left, "left").join(binned(right, "right"), ["key", "bin"])
    meet = (F.col("left.starts") < F.col("right.ends")) & (F.col("right.starts") < F.col("left.ends")) & (F.col("bin") == F.greatest("left_first", "right_first"))
    return pairs.where(meet).select("left", "right", F.greatest("left.starts", "right.starts").alias("starts"), F.least("left.ends", "right.ends").alias("ends"))


def trailing(probes: DataFrame, hours: int = 24, rows: int = ROWS) -> DataFrame:
    """probes (source, ts, failed, and a column `id` that settles equal times) with probes, failures and flaps of their source in the `hours` up to and at their time.

    A flap is a probe whose outcome differs from the source's last one. Null
    sources and times are left out. A probe comes in at its time and goes out
    once it is older than `hours`; running sums of what comes and goes are what
    the windows hold, so that work does not grow with the rows in a window.
    """
    kept = probes.where("source is not null and ts is not null").select("source", "ts", "failed", "id")
    lined = last_before(in_blocks(kept, [F.asc("source"), F.asc("ts"), F.asc_nulls_first("id")], rows), "source", F.col("failed"), "earlier")
    flap = F.coalesce(F.col("failed") != F.col("earlier"), F.lit(False))
    timed = written(lined.select("source", "ts", "id", "failed", flap.alias("flap"), micros(F.col("ts")).alias("at")))
    one = {"probes": F.lit(1), "known": F.col("failed").isNotNull().cast("int"), "failures": F.coalesce(F.col("failed").cast("int"), F.lit(0)), "flaps": F.col("flap").cast("int")}
    comes = F.struct(F.col("at"), *(x.alias(n) for n, x in one.items()))
    goes = F.struct((F.col("at") + hours * 3_600_000_000 + 1).alias("at"), *((-x).alias(n) for n, x in one.items()))
    moments = timed.select("source", F.inline(F.array(comes, goes))).groupBy("source", "at").agg(*(F.sum(n).alias(n) for n in one))
    held = running_sums(in_blocks(moments, [F.asc("source"), F.asc("at")], rows), "source", {n: F.col(n) for n in one})
    failures = F.when(F.col("known") > 0, F.col("failures")).alias("failures")
    return timed.join(held, ["source", "at"]).select("source", "ts", "id", "failed", "probes", failures, "flaps")
