"""Token counts from an exact histogram of encoded lengths.

Documents are encoded once and aggregated by length. Suffix sums over the
histogram answer, for every context limit, how many documents exceed it, how
many tokens there are in all and how many stay when each document is cut at
the limit. Lengths are summed in buckets first, so that no task sorts them all.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fedseek.llm.common import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUCKET = 1024
#: Runs of white space that are encoded apart; the encoder's pattern steps back over a run character by character.
RUN = regex.compile(r"\p{White_Space}{256,}")


def encoded_length(enc, text: str) -> int:
    """Tokens of text. The pattern takes a run of white space before another character without its last, so texts can be cut there."""
    n = at = 0
    for run in RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        n += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:]))


def token_count(spark: SparkSession, text: str, tokenizer: str = TOKENIZER) -> Column:
    """Length of text encoded by a ranks file of byte-level BPE. Special strings count as ordinary text; null and empty: 0.

    The file is read by the driver and sent to the tasks; vocabularies are
    fixed files of a megabyte or two, and one of over 64 MB is refused.
    """
    import public_tokenizers

    with open(tokenizer, "rb") as f:
        raw = f.read(64 << 20 | 1)
    if len(raw) > 64 << 20:
        raise ValueError(f"{tokenizer} is too large to send to each task")
    ranks, pattern = spark.sparkContext.broadcast(raw), public_tokenizers.PATTERN

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        pairs = map(bytes.split, ranks.value.splitlines())
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        for texts in batches:
            yield pd.Series([encoded_length(enc, x) if x else 0 for x in texts], dtype="int64")

    return count(F.col(text))


def histogram(lengths: DataFrame, length: str = "length") -> DataFrame:
    """length, n_docs: one row per distinct length; a null length counts as 0."""
    return lengths.groupBy(F.coalesce(F.col(length), F.lit(0).cast("long")).alias("length")).agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A row for each distinct length L as context limit.

    n_docs: documents of that length; n_over: longer ones; tokens_total: of
    all documents; tokens_within: of documents of at most L; truncated_total:
    when each document is cut at L; share_within: share of documents of at
    most L, so that the q-quantile is the first L with share_within >= q. No
    documents: no rows. Between two rows the truncated total is linear:
    see truncated_total().
    """
    # read twice below; without this the documents would be encoded twice
    h = stored(hist).withColumn("bucket", F.expr(f"length div {bucket}")).withColumn("t", F.col("length") * F.col("n_docs"))
    sums = h.groupBy("bucket").agg(F.sum("n_docs").alias("bn"), F.sum("t").alias("bt"))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = sums.select("bucket", F.coalesce(F.sum("bn").over(after), F.lit(0)).alias("bn"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("bt"), F.sum("bn").over(every).alias("docs"), F.sum("bt").over(every).alias("tokens_total"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("an", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("at", F.coalesce(F.sum("t").over(inside), F.lit(0))).join(sums, "bucket")
    over, beyond = F.col("an") + F.col("bn"), F.col("at") + F.col("bt")
    within = F.col("tokens_total") - beyond
    return h.select(
        "length",
        "n_docs",
        over.alias("n_over"),
        "tokens_total",
        within.alias("tokens_within"),
        (within + F.col("length") * over).alias("truncated_total"),
        ((F.col("docs") - over) / F.col("docs")).alias("share_within"),
    )


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """truncated_total at any limit >= 0, from the row of the longest length that is not above it; one row."""
    within = F.when(F.col("length") <= limit, F.col("length"))
    best = table.agg(F.max_by(F.struct("length", "n_over", "truncated_total"), within).alias("r"), F.max(within).alias("l"), F.sum("n_docs").alias("docs"))
    best = best.withColumn("r", F.when(F.col("l").isNotNull(), F.col("r")))
    return best.select(F.coalesce(F.col("r.truncated_total") + (limit - F.col("r.length")) * F.col("r.n_over"), F.coalesce("docs", F.lit(0)) * limit).alias("truncated_total"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents does not exceed; one row, null if there are none."""
    return table.where(F.col("share_within") >= q).agg(F.min("length").alias("length"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedseek.llm.common import documents

    docs = documents(spark, sf_dir).select("text")
    return limits(histogram(docs.select(token_count(spark, "text").alias("length"))))
