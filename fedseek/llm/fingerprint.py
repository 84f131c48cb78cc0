"""Document fingerprints by winnowing.

The tokens of a text (lower case; a word, or a single character of a script
that is written without spaces; a run of over LONGEST characters is taken in
pieces) are hashed, and rolling hashes of K tokens are built from them by
doubling. In every window of W such grams the one with the least hash is
chosen, the rightmost of equal ones. A passage of K + W - 1 tokens that two
texts share thus yields a common fingerprint, and its positions say where.

A gram and its position are one number, hash above, position counted down
below, so that the least number is the least hash, rightmost first, and the
minimum over W grams is log2(W) element-wise minima of shifted arrays. All of
it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fedseek.llm.common import stored

K, W, LONGEST = 5, 4, 32
#: Fixed value: scripts written without spaces.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[{UNSPACED}]|[^\s{UNSPACED}]{{1,{LONGEST}}}"
#: Bits and mask of a position.
LOW, MASK = 31, 2**31 - 1
#: Ids to a block of the order by id.
BLOCK = 256


def _shifted(c: str, by: int) -> Column:
    return F.slice(c, by + 1, F.greatest(F.size(c) - by, F.lit(0)))


def with_prints(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: array of chosen grams of text, each hash << 31 | (2^31 - 1 - token position), by position.

    Under K tokens: one gram of all of them. No token: an empty array. A null text counts as empty.
    Each step is a column of its own, so that no step is evaluated twice.
    """
    h, g, m, keep = "_h", "_g", "_m", df.columns
    pair = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn(h, F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x)))
    df = df.withColumn("_n", F.size(h))
    df = df.withColumn(g, F.zip_with(h, _shifted(h, 1), pair))
    df = df.withColumn(g, F.zip_with(g, _shifted(g, 2), pair))
    df = df.withColumn(g, F.zip_with(g, _shifted(h, 4), pair))
    few = F.when(F.col("_n") == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.aggregate(h, F.lit(0).cast("long"), pair)))
    df = df.withColumn(g, F.when(F.col("_n") < K, few).otherwise(F.slice(g, 1, F.greatest(F.col("_n") - (K - 1), F.lit(0)))))
    df = df.withColumn(m, F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 32), LOW).bitwiseOR(F.lit(MASK) - i.cast("long"))))
    width = 1
    while width < W:
        df = df.withColumn(m, F.zip_with(m, _shifted(m, width), lambda a, b: F.least(a, b)))
        width *= 2
    windows = F.when(F.size(m) == 0, 0).otherwise(F.greatest(F.size(m) - (W - 1), F.lit(1)))
    return df.withColumn(out, F.array_distinct(F.slice(m, 1, windows))).select(*keep, out)


def shown(prints: Column) -> Column:
    """hash:position of each chosen gram, in hexadecimal and decimal digits."""
    one = lambda x: F.concat(F.hex(F.shiftrightunsigned(x, LOW)), F.lit(":"), (F.lit(MASK) - x.bitwiseAND(F.lit(MASK))).cast("string"))
    return F.array_join(F.transform(prints, one), " ")


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: F.shiftrightunsigned(x, LOW)))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes in all hashes of two hash sets; two empty sets are alike."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def _next_blocks(blocks: DataFrame) -> DataFrame:
    """block, next_block: the next lower block, and for the lowest the highest. Sorted by range, joined over the ranges' ends."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(blocks.repartitionByRange(n, "block").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max("block").alias("top"))  # one row per partition
    below = Window.orderBy(F.desc("part"))
    ends = ends.select("part", F.coalesce(F.lead("top").over(below), F.max("top").over(Window.partitionBy())).alias("top"))
    inside = Window.partitionBy("part").orderBy(F.desc("block"))
    return ranged.withColumn("lower", F.lead("block").over(inside)).join(ends, "part").select("block", F.coalesce("lower", "top").alias("next_block"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """op1's rows: each document with its edited text and the next document, by descending id.

    docs has doc_id and text. Rows of one doc_id follow each other by hash of
    the text. Null text: empty. A row without doc_id has no next document: its
    edited text is its first half and near_next is 0. A single document is its
    own next. Text moves once, to its block of BLOCK ids; only the first
    document of each block moves again, to the block before.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = docs.where(F.col("doc_id").isNotNull()).withColumn("block", F.expr(f"(doc_id - pmod(doc_id, {BLOCK})) div {BLOCK}"))
    order = Window.partitionBy("block").orderBy(F.desc("doc_id"), F.desc(F.xxhash64("text")))
    firsts = own.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    firsts = with_prints(firsts.select(F.col("block").alias("next_block"), F.col("text").alias("first_text")), "first_text", "first_prints")
    firsts = _next_blocks(own.select("block").distinct()).join(firsts, "next_block").select("block", "first_text", hashes(F.col("first_prints")).alias("first_set"))
    # dealt by block before anything is computed, so that only texts move
    rows = with_prints(own.repartition("block"), "text", "prints").withColumn("set", hashes(F.col("prints")))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_set", F.lead("set").over(order))
    rows = rows.join(firsts, "block").select("doc_id", "text", "prints", "set", F.coalesce("next_text", "first_text").alias("next_text"), F.coalesce("next_set", "first_set").alias("next_set"))
    lone = with_prints(docs.where(F.col("doc_id").isNull()), "text", "prints").withColumn("set", hashes(F.col("prints"))).select("doc_id", "text", "prints", "set", F.lit("").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_set"))
    rows = rows.unionByName(lone).withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    near_next = F.when(F.col("next_set").isNull(), F.lit(0.0)).otherwise(likeness(F.col("set"), F.col("next_set")))
    rows = rows.select("doc_id", "n_chars", "set", shown(F.col("prints")).alias("fingerprint"), near_next.alias("near_next"), F.concat(F.left("text", F.col("n_chars").cast("int") - F.col("half")), F.left("next_text", F.col("half"))).alias("edited"))
    rows = with_prints(rows, "edited", "edited_prints").withColumn("edited_set", hashes(F.col("edited_prints")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", shown(F.col("edited_prints")).alias("edited_fingerprint"), likeness(F.col("set"), F.col("edited_set")).alias("near_edited"), "near_next")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedseek.llm.common import documents

    return edited_pairs(documents(spark, sf_dir))
