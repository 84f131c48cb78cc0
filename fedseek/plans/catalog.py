"""The registered queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedseek.functions.text import contains_keyword, has_token
from fedseek.operators import health, search, state, telemetry
from fedseek.plans import searches, timelines
from fedseek.plans.bindings import PROBES as _PROBES
from fedseek.sources.tables import document_items, page_items, probes, scratch_dir, table, tolerant, unified_items, write_bytes
from fedseek.streaming.health import hourly

KEYWORD, TAG, K = "the", "ou", 20


def federated_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: hits of one keyword from sources that are not dead, ranked and bounded."""
    return search.top(_hits_alive(spark, d), K)


def _hits_alive(spark, d):
    alive = health.skip_dead(table(spark, d, "documents"), health.by_source(probes(table(spark, d, "events"))))
    return search.matching(alive, KEYWORD)


def _items(spark, d):
    return unified_items(document_items(table(spark, d, "documents")), page_items(table(spark, d, "pages")))


def _favourites(spark, d):
    log = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error"))
    return state.favourites(log, ["user_id"], ["ts", "event_id"], "event_type", "purchase").select("user_id", "event_id", "ts")


def _favourites_by_batches(spark, d):
    """The same from a state that batches of days were merged into, out of order and one of them twice."""
    log, path = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error")).select("user_id", "event_id", "ts", "event_type"), f"{scratch_dir(spark)}/state"
    third = F.pmod(F.dayofmonth("ts"), F.lit(3))
    for batch in (2, 0, 1, 1):
        state.merge_last_rows(log.where(third == batch), path, ["user_id"], ["ts", "event_id"])
    return state.kept_rows(spark, path).where("event_type = 'purchase'").select("user_id", "event_id", "ts")


def _evolved(spark, d):
    """A log of two versions of its schema, in files, and what is read of it."""
    events, path = table(spark, d, "events"), scratch_dir(spark)
    state.append_log(events.where("event_type = 'view'").select("event_id", "user_id"), path)
    state.append_log(events.where("event_type = 'click'").select("event_id", "user_id", "props"), path)
    return state.read_log(spark, path).groupBy("user_id").agg(F.count("*").alias("n"), F.count("props").alias("with_props"))


def _resilient(spark, d):
    """Three inputs, of which one has a broken file besides and one is absent: what the search still answers, by input."""
    docs, path = table(spark, d, "documents").select("doc_id", "source", "n_chars", "text"), scratch_dir(spark)
    for i in (0, 1):
        docs.where(F.col("doc_id") % 3 == i).write.parquet(f"{path}/in{i}")
    write_bytes(spark, f"{path}/in1/part-broken.parquet", b"not a table")
    found, _ = tolerant(spark, [f"{path}/in{i}" for i in range(3)], docs.schema)
    return search.matching(found, KEYWORD)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "federated_search": federated_search,
    "a1_hits_by_source": lambda s, d: search.hits_by_source(table(s, d, "documents"), KEYWORD),
    "a2_keyword_match": lambda s, d: search.matching(table(s, d, "documents"), KEYWORD),
    "a3_result_form": lambda s, d: _items(s, d).select("origin", "item_id", "source", F.md5("title").alias("title_md5"), F.length("body").alias("body_chars"), "link"),
    "a4_bag_union": lambda s, d: _items(s, d).where(contains_keyword(F.col("body"), KEYWORD)).groupBy("origin", "source").agg(F.count("*").alias("hits")),
    "a5_ranked": lambda s, d: search.top(search.matching(table(s, d, "documents"), KEYWORD), 100),
    "a6_tag_filter": lambda s, d: search.with_tag(table(s, d, "documents"), "text", TAG).select("doc_id", "source"),
    "a6_tag_flag": lambda s, d: table(s, d, "documents").select("doc_id", has_token(F.col("text"), "4k").alias("is_4k"), has_token(F.col("text"), TAG).alias("has_tag")),
    "a7_skip_dead": _hits_alive,
    "a8_health_by_source": lambda s, d: health.by_source(probes(table(s, d, "events"))),
    "a8_health_by_day": lambda s, d: health.by_day(probes(table(s, d, "events"))),
    "a9_fault_isolation": _resilient,
    "a10_favourites": _favourites,
    "a10_favourites_merged": _favourites_by_batches,
    "a11_history": lambda s, d: state.history(table(s, d, "events").where("event_type = 'view'"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id", "position"),
    "a12_telemetry": lambda s, d: telemetry.anonymous(table(s, d, "events")),
    "a13_links": lambda s, d: page_items(table(s, d, "pages")).where(F.col("link").isNotNull()).select("item_id", "link"),
    "a14_source_dimension": lambda s, d: health.source_dimension(probes(table(s, d, "events"))),
    "a15_health_report": lambda s, d: health.report(probes(table(s, d, "events"))),
    "a16_evolved_log": _evolved,
    "e1_collapse_copies": lambda s, d: search.collapse(table(s, d, "documents")),
    "e2_top_per_source": lambda s, d: search.top_per_source(search.matching(table(s, d, "documents"), KEYWORD), 3),
    "e3_hourly_health": lambda s, d: hourly(probes(table(s, d, "events"))).withColumn("hour", F.col("hour").cast("timestamp_ntz")),
}

_TF = "((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::bigint"
_HITS = f"SELECT doc_id, source, n_chars, {_TF} AS tf FROM documents WHERE contains(lower(text), 'the')"
_HEALTH = f"SELECT source, count(*) AS probes, count(*) FILTER (failed) AS failures, count(*) FILTER (failed) * 100 >= count(*) * 22 AS dead FROM ({_PROBES}) GROUP BY source"
_ALIVE = f"SELECT * FROM ({_HITS}) h WHERE NOT EXISTS (SELECT 1 FROM ({_HEALTH}) x WHERE x.dead AND x.source = h.source)"
_ORDER = "tf DESC NULLS LAST, n_chars NULLS LAST, doc_id NULLS LAST"
_ITEMS = (
    "SELECT 'documents' AS origin, doc_id AS item_id, source, left(text, 60) AS title, text AS body, NULL::varchar AS link FROM documents"
    " UNION ALL SELECT 'pages', page_id, regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1), trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), html, url FROM pages"
)


def _token(t: str) -> str:
    return rf"coalesce(regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){t}($|[^\p{{L}}\p{{N}}_])'), false)"


ORACLES: dict[str, str] = {
    "federated_search": f"SELECT *, row_number() OVER (ORDER BY {_ORDER})::int AS rank FROM ({_ALIVE}) ORDER BY {_ORDER} LIMIT 20",
    "a1_hits_by_source": f"SELECT source, count(*) FILTER (contains(lower(text), 'the')) AS hits, sum({_TF})::bigint AS occurrences, count(*) AS items FROM documents GROUP BY source",
    "a2_keyword_match": _HITS,
    "a3_result_form": f"SELECT origin, item_id, source, md5(title) AS title_md5, length(body)::int AS body_chars, link FROM ({_ITEMS})",
    "a4_bag_union": f"SELECT origin, source, count(*) AS hits FROM ({_ITEMS}) WHERE contains(lower(body), 'the') GROUP BY origin, source",
    "a5_ranked": f"SELECT *, row_number() OVER (ORDER BY {_ORDER})::int AS rank FROM ({_HITS}) ORDER BY {_ORDER} LIMIT 100",
    "a6_tag_filter": f"SELECT doc_id, source FROM documents WHERE {_token('ou')}",
    "a6_tag_flag": f"SELECT doc_id, {_token('4k')} AS is_4k, {_token('ou')} AS has_tag FROM documents",
    "a7_skip_dead": _ALIVE,
    "a8_health_by_source": _HEALTH,
    "a8_health_by_day": f"SELECT source, ts::date AS day, count(*) AS probes, count(*) FILTER (failed) AS failures FROM ({_PROBES}) GROUP BY ALL",
    "a9_fault_isolation": f"SELECT * FROM ({_HITS}) WHERE doc_id % 3 < 2",
    "a10_favourites": "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) AS n FROM events WHERE event_type IN ('purchase', 'error')) WHERE n = 1 AND event_type = 'purchase'",
    "a10_favourites_merged": "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) AS n FROM events WHERE event_type IN ('purchase', 'error')) WHERE n = 1 AND event_type = 'purchase'",
    "a11_history": "SELECT user_id, event_id, n::int AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) AS n FROM events WHERE event_type = 'view') WHERE n <= 5",
    "a12_telemetry": "SELECT ts::date AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "a13_links": "SELECT page_id AS item_id, url AS link FROM pages WHERE url IS NOT NULL",
    "a14_source_dimension": f"SELECT source, min(ts)::date AS first_day, max(ts)::date AS last_day, count(DISTINCT ts::date) AS days_active FROM ({_PROBES}) GROUP BY source",
    "a15_health_report": f"SELECT source, count(*) AS probes, count(*) FILTER (failed) AS failures, max(ts) AS last_probe, count(*) FILTER (failed) * 100 >= count(*) * 22 AS dead, count(*) FILTER (failed) * 1000 // count(*) AS failure_permille FROM ({_PROBES}) GROUP BY source",
    "a16_evolved_log": "SELECT user_id, count(*) AS n, count(p) AS with_props FROM (SELECT user_id, CASE WHEN event_type = 'click' THEN props END AS p FROM events WHERE event_type IN ('view', 'click')) GROUP BY user_id",
    "e1_collapse_copies": "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY md5(text)",
    "e2_top_per_source": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER})::int AS rank FROM ({_HITS})) WHERE rank <= 3",
    "e3_hourly_health": f"SELECT source, date_trunc('hour', ts) AS hour, count(*) AS probes, count(*) FILTER (failed) AS failures FROM ({_PROBES}) GROUP BY ALL",
}

QUERIES |= searches.QUERIES | timelines.QUERIES
ORACLES |= searches.ORACLES | timelines.ORACLES
