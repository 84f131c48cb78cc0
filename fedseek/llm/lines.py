"""Line dedup by the spread of a line over sites.

A line that stands on many sites is boilerplate. The number of sites of each
line is estimated by a HyperLogLog sketch per line hash; partial sketches merge
by aggregation, so that a line in a third of all rows is no hot key. Lines
whose estimate is near the threshold get an exact distinct count. Only lines
seen often enough to reach the threshold at all are sketched: a count of
occurrences, which needs a fixed width per line, comes first and is exact.

The first occurrence of a boilerplate line (smallest doc_id, then position)
stays, so that no wording leaves the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedseek.llm.common import free_name, stored

SITES, LG_K = 10, 9
#: Boilerplate lines that may be sent to all tasks.
SENT = 1_000_000
#: Five standard errors of a sketch of 2^LG_K registers, as a share of the count, and one for small counts.
BAND = 5 * 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """What makes two lines one: outer white space does not count; a blank line has no key."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(bare != "", F.xxhash64(bare))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of id and text), site, pos, line (hash) of each line that is not blank."""
    exploded = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("source").alias("site"), F.posexplode(F.transform(_lines(F.col("text")), _key)).alias("pos", "line"))
    return exploded.where(F.col("line").isNotNull())


def spread(docs: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """line, sites, exact: lines on at least `sites` distinct sites; exact says whether sites was counted or estimated."""
    rows = line_rows(docs).select("line", "site")
    often = rows.groupBy("line").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b")).where((F.col("n") >= sites) & ((F.col("a") != F.col("b")) | F.lit(sites <= 1))).select("line")
    often = stored(often)
    # occurrences of lines that can matter, a row for each line and site of a task
    rows = rows.join(often, "line", "left_semi")
    estimated = stored(rows.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("sites")))
    band = F.greatest(F.lit(sites * BAND), F.lit(1.0))
    sure = estimated.where(F.col("sites") > sites + band).select("line", "sites", F.lit(False).alias("exact"))
    near = estimated.where(F.abs(F.col("sites") - sites) <= band).select("line")
    counted = rows.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= sites).select("line", "sites", F.lit(True).alias("exact"))
    return sure.unionByName(counted)


def deduplicated(docs: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """docs with boilerplate lines cut from text, all columns as they were, and n_lines_removed (with underscores in front if docs has the name).

    docs has doc_id, text, source. The removed lines go with their line feed;
    text without such lines is not touched. A null source is a site of its own.
    A null or empty text has no lines and stays as it is. Rows that repeat a
    doc_id with its text count as the same document: they lose the same lines.
    A blank line is never boilerplate. Lines are compared without outer blanks.
    No rows: no rows.
    """
    h, own, gone, removed = free_name(docs, "line_h", "line_doc", "line_gone", "n_lines_removed")
    boiler = stored(spread(docs, sites, lg_k).select("line"))
    # few: they go to all tasks, and a line in a third of all rows is not gathered; many: the skew join splits it
    sent = F.broadcast if boiler.count() <= SENT else lambda x: x
    hits = stored(line_rows(docs).join(sent(boiler), "line", "left_semi").select("line", "doc_id", "h", "pos"))
    # the place of the first occurrence: one row per boilerplate line
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"), F.col("pos").alias("pos"))
    first = hits.groupBy("line").agg(F.min(place).alias("first"))
    cut = hits.join(sent(first), "line").where(~place.eqNullSafe(F.col("first")))
    # a document's own lines only: bounded by its text
    cut = cut.groupBy(F.col("doc_id").alias(own), F.col("h").alias(h)).agg(F.collect_set("pos").alias(gone))
    lines = _lines(F.col("text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    cut = cut.withColumnRenamed(h, h + "_")
    out = docs.withColumn(h, F.xxhash64("doc_id", "text")).join(cut, (F.col(h) == F.col(h + "_")) & F.col("doc_id").eqNullSafe(F.col(own)), "left")
    out = out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.withColumn(removed, F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))).drop(h, h + "_", own, gone)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what is left: doc_id, n_lines, n_removed, kept_sha256."""
    from fedseek.llm.common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text", "source", F.size(_lines(F.col("text"))).alias("n_lines"))
    out = deduplicated(docs)
    return out.select("doc_id", "n_lines", F.col("n_lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, nullif(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '') AS key FROM l),
b AS (SELECT key, min((doc_id, pos)) AS first FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT source) >= {SITES}),
m AS (SELECT k.*, b.key IS NOT NULL AND (k.doc_id, k.pos) <> b.first AS gone FROM k LEFT JOIN b ON k.key = b.key)
SELECT doc_id, count(*)::int AS n_lines, (count(*) FILTER (gone))::int AS n_removed,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
