"""Positional inverted index over texts: keyword, phrase and ranked search without reading them (A2, A5).

A term is a run of letters, digits and _ of any script, in lower case. The
index is a folder of tables:

- postings: term, doc_id, h (hash of the text), n (words of the document), tf,
  positions; in folders by `bucket`, the checksum of the term, and sorted by
  term, so that a query reads the parts of files that have its terms. A bucket's
  terms are written by as many tasks as it needs. A term in over `hot` documents
  is dealt over blocks of documents, so that no task holds all of it.
- terms: term, df (documents), cf (occurrences).
- documents: doc_id, h, n and the fields that searches may name.

A document is its id and text: rows that repeat both are one, rows that share
only the id are several. Rows without doc_id are not in the index, as a result
names documents by id. Null and empty texts have no terms but count as
documents.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedseek.sources.tables import scratch_dir, written

SEPARATOR = r"[^\p{L}\p{N}_]+"
#: Postings of a bucket, documents of a term from which it is dealt over blocks.
BUCKET, HOT = 20_000_000, 1_000_000
#: Postings that a task sorts and writes, on average; places in a text for each of `hot` documents, beyond which a term has more blocks.
TASK, PLACES = 2_000_000, 16
#: BM25's saturation of tf and weight of length; scores are sums of whole millionths, so that their order of addition makes no difference.
K1, B, UNIT = 1.2, 0.75, 1_000_000


def terms_in(text: Column) -> Column:
    """Array of the terms of text in order; null for null."""
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != "")


def runs(words: Column) -> Column:
    """Array of (term, positions) of the words of one text: its words sorted, each run of equal ones cut out."""

    def cut(lined: Column) -> Column:
        last = F.size(lined)
        ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | (F.get(lined, i)["word"] != F.get(lined, i - 1)["word"]))

        def run(first: Column, end: Column) -> Column:
            # not a slice, which would copy the whole array first
            return F.struct(F.get(lined, first)["word"].alias("term"), F.transform(F.sequence(first, end - 1), lambda j: F.get(lined, j)["at"]).alias("positions"))

        return F.transform(F.array(ends), lambda e: F.zip_with(F.slice(F.concat(F.array(F.lit(0)), e), 1, F.size(e)), e, run))[0]

    lined = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
    # what is used for each element is bound to a variable, else it would be computed for each
    return F.when(F.size(words) > 0, F.transform(F.array(lined), cut)[0])


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    terms: DataFrame
    documents: DataFrame
    #: documents and words in them; folders of postings
    n_documents: int
    n_words: int
    buckets: int

    def of(self, terms: list[str]) -> DataFrame:
        """Postings of some terms."""
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(sorted(set(terms)))).drop("bucket")


def build(docs: DataFrame, path: str, fields: tuple[str, ...] = (), bucket_rows: int = BUCKET, hot: int = HOT) -> Index:
    """Writes an index of docs (doc_id, text, fields) to path."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(terms_in(F.col("text")), F.array().cast("array<string>")).alias("words"), *fields)
    sizes = rows.groupBy("doc_id", "h").agg(F.max(F.size("words")).alias("n"), *(F.min(f).alias(f) for f in fields), F.count("*").alias("copies"))
    documents = written(sizes, f"{path}/documents")
    if documents.where("copies > 1").limit(1).count():  # only then are the words moved
        rows = rows.dropDuplicates(["doc_id", "h"])
    each = rows.select("doc_id", "h", F.size("words").alias("n"), F.explode(runs(F.col("words"))).alias("run"))
    found = written(each.select("run.term", "doc_id", "h", "n", F.size("run.positions").alias("tf"), "run.positions"))
    terms = written(found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), f"{path}/terms")
    total = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    buckets = max(-(-total // bucket_rows), 8)
    tasks = buckets * max(-(-total // (buckets * TASK)), 1)
    blocks = F.ceil(F.greatest(F.col("df") / hot, F.col("cf") / (hot * PLACES)))
    # few terms are hot, so they are a small table; if not, the join is by term and splits what is skewed
    frequent = written(terms.select("term", blocks.alias("blocks")).where("blocks > 1"))
    # a bucket's terms are in each slot that has its number modulo buckets; blocks go to the slots after the term's own
    slot = F.crc32(F.col("term").cast("binary")) % tasks
    block = F.coalesce(F.pmod(F.xxhash64("doc_id", "h"), "blocks"), F.lit(0))
    dealt = found.join(frequent, "term", "left").withColumn("bucket", (slot % buckets).cast("int")).withColumn("task", ((slot + block) % tasks).cast("int"))
    postings = dealt.repartitionById(tasks, "task").sortWithinPartitions("bucket", "term", "doc_id", "h")
    postings.select("term", "doc_id", "h", "n", "tf", "positions", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    return opened(docs.sparkSession, path, buckets)


def opened(spark: SparkSession, path: str, buckets: int) -> Index:
    """An index that build() wrote into as many buckets."""
    documents = spark.read.parquet(f"{path}/documents")
    n, words = documents.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    postings = spark.read.schema("term string, doc_id bigint, h bigint, n int, tf int, positions array<int>, bucket int").parquet(f"{path}/postings")
    return Index(postings, spark.read.parquet(f"{path}/terms"), documents, n, words, buckets)


def scratch_index(docs: DataFrame, *fields: str, **how) -> Index:
    """An index that lasts as long as the driver."""
    return build(docs, f"{scratch_dir(docs.sparkSession)}/index", fields, **how)


def ranked(index: Index, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, h, score of each document with any of terms, by BM25 in millionths. A term that is given twice counts twice; one that no text has adds nothing."""
    df = {r.term: r.df for r in index.terms.where(F.col("term").isin(sorted(set(terms)))).collect()}
    average = index.n_words / max(index.n_documents, 1)
    score = F.lit(0.0)
    for t in sorted(df):
        idf = math.log(1 + (index.n_documents - df[t] + 0.5) / (df[t] + 0.5))
        score = F.when(F.col("term") == t, F.lit(idf * terms.count(t))).otherwise(score)
    part = score * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(average or 1.0)))
    return index.of(terms).groupBy("doc_id", "h").agg(F.sum(F.round(part * UNIT).cast("long")).alias("score"))


def best(index: Index, terms: list[str], k: int, **how) -> DataFrame:
    """doc_id, score, rank of the k best documents; equal scores by doc_id, then by the hash of the text."""
    from pyspark.sql import Window

    order = F.desc("score"), F.asc("doc_id"), F.asc("h")
    return ranked(index, terms, **how).orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("h")


def starts(words: list[str]) -> Column:
    """Of the postings of one document, grouped: where the words stand one after the other. Rows of words that occur several times count for each place."""

    def begins(i: int) -> Column:
        return F.transform(F.flatten(F.collect_list(F.when(F.col("term") == words[i], F.col("positions")))), lambda p: p - i)

    return reduce(F.array_intersect, map(begins, range(len(words))))


def phrase(index: Index, words: list[str]) -> DataFrame:
    """doc_id, h, tf of documents that have words one after the other; occurrences may overlap. words: terms, at least one."""
    if not words:
        raise ValueError("a phrase needs a word")
    found = index.of(words).groupBy("doc_id", "h").agg(F.size(starts(words)).alias("tf"))
    return found.where("tf > 0")
