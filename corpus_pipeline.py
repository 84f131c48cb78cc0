"""From raw documents to a training mix, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)); it takes all that the
stage before kept. All but the last return the columns of documents; the last
repeats each document as often as the mix takes it and adds copy_no.

In every stage a document is its doc_id, null or not, with its text; other
columns come through as they are, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedseek.llm import common, decontaminate, language, lines, mixing, ngram_join


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages.

    Rejected, so dropped: a null or empty text, one without a letter, and one
    too unlike all languages. A null lang teaches nothing and is no ground for
    dropping. Repeated rows share their fate; of equally near languages the
    first by name counts. Without any lang nothing is learned and all go.
    """
    return language.accepted(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites stay once. n_chars follows the text where lines went.

    All rows stay; a text whose lines all go is empty. A null or empty text is
    left as it is. A null source is one more site. The first by (doc_id, null
    last, hash of id and text, position) keeps a line; rows that repeat a
    document lose the same lines. Blank lines are never cut.
    """
    held = {c: common.free_name(docs, f"held_{c}")[0] for c in docs.columns if c.lower() == "n_lines_removed"}
    out = lines.deduplicated(docs.withColumnsRenamed(held))
    chars = F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).drop("n_lines_removed").withColumnsRenamed({v: c for c, v in held.items()})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle likeness of 0.8 or more.

    The smallest by (doc_id, null last, hash of id and text) stays, in one row
    if several repeat it. Rows without a word, null ones included, all stay:
    they are like nothing.
    """
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    A null or empty text has none and stays. Rows that repeat a document go or
    stay together. Null and empty items are in no document; equal items count
    once. Without items all rows stay.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights.

    A text without a word, a null one included, is never taken. A null source
    is a source of its own, the last. Rows that repeat a document are taken
    equally often.
    """
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("lines", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("leaks", drop_leaks),
    ("mix", mix_sources),
]

#: Language models and random copies have no SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage has written on its way is deleted after it, and the stage before's result once it is read."""
    docs, kept = common.documents(spark, sf_dir), []
    for _, stage in STAGES:
        with common.scratch(spark, kept):
            docs = common.stored(stage(spark, docs, sf_dir))
            kept.append(docs)
        if len(kept) > 1:
            common.dropped(kept.pop(0))
    return docs
