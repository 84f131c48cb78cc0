"""Queries along time: health as of a moment, periods, sessions, overlaps, trailing windows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedseek.operators import health, timeline
from fedseek.plans.bindings import PROBES, SOURCE
from fedseek.sources.tables import event_source, probes, table
from fedseek.streaming import health as streams

GAP, SESSION = 6 * 3600, 30 * 60


def _hourly_known(spark, d) -> DataFrame:
    """Health of each hour, known when the hour is over."""
    known = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("ts") + 1)
    return probes(table(spark, d, "events")).groupBy("source", known.alias("known")).agg(F.count("*").alias("probes"), F.count_if("failed").alias("failures"))


def _as_of(spark, d) -> DataFrame:
    """View events with the health of their source in the last hour with probes that was over by then."""
    views = table(spark, d, "events").where("event_type = 'view' and user_id is not null").select("event_id", event_source().alias("source"), "ts")
    return timeline.as_of(views, _hourly_known(spark, d), "source", "ts", "known", ["known", "probes", "failures"])


def _periods(spark, d) -> DataFrame:
    days = health.by_day(probes(table(spark, d, "events"))).withColumn("dead", F.col("failures") * 100 >= F.col("probes") * health.DEAD_PERCENT)
    return timeline.periods(days, "source", "day", "dead")


def _overlaps(spark, d) -> DataFrame:
    """Sessions of users that ran while their source was dead, and for how long."""
    own = timeline.sessions(table(spark, d, "events"), "user_id", "ts", SESSION)
    own = own.select("user_id", "session", event_source().alias("source"), "starts", (F.col("last") + F.make_dt_interval(secs=F.lit(SESSION))).alias("ends"))
    dead = _periods(spark, d).where("dead").select("source", F.col("starts").cast("timestamp_ntz").alias("starts"), F.col("ends").cast("timestamp_ntz").alias("ends"))
    return timeline.overlaps(own, dead, "source").select("left.user_id", "left.session", "left.source", F.col("right.starts").alias("dead_since"), "starts", "ends")


def _outages(spark, d) -> DataFrame:
    return timeline.sessions(probes(table(spark, d, "events")).where("failed"), "source", "ts", GAP)


def _outage_windows(spark, d) -> DataFrame:
    """The stream's sessions over the whole table."""
    found = streams.outages(probes(table(spark, d, "events"), F.col("event_id").alias("id")))
    return found.select("source", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("starts", "last")), "failures")


QUERIES = {
    "a7_health_as_of": _as_of,
    "a8_outage_sessions": _outages,
    "a8_outage_windows": _outage_windows,
    "a8_trailing_health": lambda s, d: timeline.trailing(probes(table(s, d, "events"), F.col("event_id").alias("id"))),
    "a14_periods": _periods,
    "a14_overlaps": _overlaps,
}


def _sessions(rows: str, key: str, gap: int) -> str:
    return (
        f"SELECT {key}, session, min(ts) AS starts, max(ts) AS last, count(*) AS events FROM (SELECT *, sum(new::int) OVER (PARTITION BY {key} ORDER BY ts)::bigint AS session FROM"
        f" (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts) >= INTERVAL {gap} SECOND, true) AS new FROM ({rows}))) GROUP BY {key}, session"
    )


_DAYS = f"SELECT source, ts::date AS day, count(*) FILTER (failed) * 100 >= count(*) * 22 AS dead FROM ({PROBES}) GROUP BY ALL"
_PERIODS = f"SELECT source, dead, min(day) AS starts, max(day) + 1 AS ends, count(*) AS days FROM (SELECT *, day - (row_number() OVER (PARTITION BY source, dead ORDER BY day))::int AS g FROM ({_DAYS})) GROUP BY source, dead, g"

ORACLES = {
    "a7_health_as_of": f"WITH h AS (SELECT source, date_trunc('hour', ts) + INTERVAL 1 HOUR AS known, count(*) AS probes, count(*) FILTER (failed) AS failures FROM ({PROBES}) GROUP BY ALL),"
    f" v AS (SELECT event_id, {SOURCE} AS source, ts FROM events WHERE event_type = 'view' AND user_id IS NOT NULL)"
    " SELECT v.event_id, v.source, v.ts, h.known, h.probes, h.failures FROM v ASOF LEFT JOIN h ON v.source = h.source AND v.ts >= h.known",
    "a8_outage_sessions": _sessions(f"SELECT * FROM ({PROBES}) WHERE failed", "source", GAP),
    "a8_outage_windows": f"SELECT source, starts, last, events AS failures FROM ({_sessions(f'SELECT * FROM ({PROBES}) WHERE failed', 'source', GAP)})",
    "a8_trailing_health": f"SELECT source, ts, id, failed, count(*) OVER w AS probes, (sum(failed::int) OVER w)::bigint AS failures, (sum(flap::int) OVER w)::bigint AS flaps"
    f" FROM (SELECT *, coalesce(failed <> lag(failed) OVER (PARTITION BY source ORDER BY ts, id), false) AS flap FROM ({PROBES}))"
    " WINDOW w AS (PARTITION BY source ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)",
    "a14_periods": _PERIODS,
    "a14_overlaps": f"WITH own AS (SELECT user_id, session, {SOURCE} AS source, starts, last + INTERVAL {SESSION} SECOND AS ends FROM ({_sessions('SELECT * FROM events WHERE user_id IS NOT NULL', 'user_id', SESSION)})),"
    f" dead AS (SELECT source, starts::timestamp AS starts, ends::timestamp AS ends FROM ({_PERIODS}) WHERE dead)"
    " SELECT o.user_id, o.session, o.source, d.starts AS dead_since, greatest(o.starts, d.starts) AS starts, least(o.ends, d.ends) AS ends"
    " FROM own o JOIN dead d ON o.source = d.source AND o.starts < d.ends AND d.starts < o.ends",
}
