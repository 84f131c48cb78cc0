"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is to be copied target / source size times: the whole
part is certain, the fraction is a probability. Pairs of documents transfer
mass, measured in words, at random from one to the other until the copy
probability of one of them is 0 or 1; what is left goes on to the next pair.
Each document keeps its expected number of copies and each pair keeps its sum
of words. The one document that stays open is rounded to the nearer number, so
that the words of a source end within half that document of the target.
The pairs form a tree: random blocks of about BLOCK / 2 documents are reduced
to one open document each, blocks of these to one, and so on. In a block large
documents come first, so that small ones settle them and a small one is left.

Only ids and sizes are moved; the random numbers are hashes of ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedseek.llm.common import WORD, stored, unit_random

BLOCK = 64
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Sources in the order of their code points, null last, get weights in turn
    and share `share` times all sizes; a target stops at `most` times its
    source and the excess goes to the others by weight. That is the level at
    which sum(min(level * weight, most * source_size)) is what there is to
    share: sources reach their stop in the order of stop / weight, so running
    sums in this order show how many stop. One row per source is sorted here.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rank = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w")).withColumn("stop", F.col("source_size") * most)
    by_stop = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    total = F.sum("source_size").over(everything) * share
    # level if this source and all after it are open; of those that stay below their stop the first has the highest, which holds
    s = s.withColumn("level", (total - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("open_level", F.max(F.when(F.col("level") * F.col("w") <= F.col("stop"), F.col("level"))).over(everything))
    fill = F.when(F.col("open_level").isNull(), F.col("stop")).otherwise(F.least(F.col("open_level") * F.col("w"), F.col("stop")))
    return s.select("source", "source_size", fill.alias("target"))


def _step(acc: Column, x: Column, seed: int) -> Column:
    """One pair: acc has the open unit (k, h, s, f) and what is settled; x is the next unit."""
    # words that can go from x to the open unit, and the other way
    up = F.least((1 - acc.f) * acc.s, x.f * x.s)
    down = F.least(acc.f * acc.s, (1 - x.f) * x.s)
    rises = unit_random(F.lit(seed), acc.k, acc.h, x.k, x.h) * (up + down) < down
    sure = lambda u, n: F.array(F.struct(u.k.alias("k"), u.h.alias("h"), F.lit(n).alias("extra")))
    keep = lambda u, f, done: F.struct(u.k.alias("k"), u.h.alias("h"), u.s.alias("s"), F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0)).alias("f"), F.concat(acc.done, done).alias("done"))
    acc_full = (1 - acc.f) * acc.s <= x.f * x.s
    acc_empty = acc.f * acc.s <= (1 - x.f) * x.s
    return (
        F.when(rises & acc_full, keep(x, x.f - up / x.s, sure(acc, 1)))
        .when(rises, keep(acc, acc.f + up / acc.s, sure(x, 0)))
        .when(acc_empty, keep(x, x.f + down / x.s, sure(acc, 0)))
        .otherwise(keep(acc, acc.f - down / acc.s, sure(x, 1)))
    )


def _reduce(units: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """A row per block: its open unit and `done`. Blocks are bounded, as keys spread distinct units by hash."""
    packed = F.sort_array(F.collect_list(F.struct("s", "k", "h", "f")), asc=False)
    first = F.col("u")[0]
    start = F.struct(first.k.alias("k"), first.h.alias("h"), first.s.alias("s"), first.f.alias("f"), F.array().cast("array<struct<k:bigint,h:bigint,extra:int>>").alias("done"))
    folded = F.aggregate(F.slice("u", 2, F.greatest(F.size("u") - 1, F.lit(0))), start, lambda acc, x: _step(acc, x, seed))
    return units.groupBy(*keys).agg(packed.alias("u")).select(*keys, folded.alias("r")).select(*keys, "r.*")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """k, h, size, source, source_size, target, copies: one row per distinct document.

    docs has doc_id, text, source; other columns are not looked at. A document
    is its doc_id with its text (k: doc_id, h: hash of id and text), and rows
    that repeat one share its decision. A null or empty text has size 0 and is
    never copied. A null source is a source of its own, the last. A null doc_id
    is a value like others. With no documents the result is empty.
    """
    rows = docs.select(F.col("doc_id").alias("k"), F.xxhash64("doc_id", "source", "text").alias("h"), "source", word_count(F.col("text")).alias("size"))
    rows = stored(rows.groupBy("k", "h", "source", "size").agg(F.count("*").alias("rows")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    shares = stored(sizes)
    per = targets(shares.select("source", "source_size"), weights, share, most).join(shares.select(F.col("source").alias("_u"), "units"), F.col("source").eqNullSafe(F.col("_u")), "left").drop("_u")
    units = rows.join(per.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("whole", F.floor(ratio).cast("int")).withColumn("f", ratio - F.floor(ratio))

    most_units = shares.agg(F.max("units")).first()[0] or 0  # one number
    levels = max(1, math.ceil(math.log(max(most_units, 2), BLOCK // 2)))
    # repeated rows weigh as one unit of their joint size
    open_units = units.where((F.col("size") > 0) & (F.col("f") > 0)).select("source", F.col("k"), "h", F.col("size").cast("double").alias("s"), "rows", "f", "units")
    first = open_units.select("source", "k", "h", (F.col("s") * F.col("rows")).alias("s"), "f", F.expr(f"pmod(xxhash64(k, h), greatest(ceil(units / {BLOCK / 2}D), 1))").alias("b"))
    level = _reduce(first, ["source", "b"], seed)
    settled = []
    for n in range(levels):
        level = stored(level)
        settled.append(level.select(F.explode("done").alias("x")).select("x.*"))
        last = n == levels - 1
        if last:
            settled.append(level.select("k", "h", (F.col("f") >= 0.5).cast("int").alias("extra")))
        else:
            # blocks of one source, near in size, meet: BLOCK / 2 to one, until one is left
            fan = (BLOCK // 2) ** (levels - 2 - n)
            spread = F.lit(0).cast("long") if fan == 1 else F.expr(f"pmod(xxhash64(k, h), {fan})")
            level = _reduce(level.select("source", "k", "h", "s", "f", spread.alias("b")), ["source", "b"], seed + n + 1)
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.unionByName(more)
    extra = extra.withColumnsRenamed({"k": "_k", "h": "_h"})
    out = units.join(extra, F.col("k").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h")), "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0))
    return out.select("k", "h", "source", "size", "rows", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    from fedseek.llm.common import documents

    m = mixed(documents(spark, sf_dir))
    # rows that repeat a document come back one by one
    m = m.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return m.select(F.col("k").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, numbered by copy_no from 1 (with underscores in front if docs has the name)."""
    from fedseek.llm.common import free_name

    h, own_h, own_k, n, i = free_name(docs, "mix_h", "mix_own_h", "mix_own_k", "mix_n", "copy_no")
    m = mixed(docs, **how).where("copies > 0").select(F.col("h").alias(own_h), F.col("k").alias(own_k), F.col("copies").alias(n))
    out = docs.withColumn(h, F.xxhash64("doc_id", "source", "text")).join(m, (F.col(h) == F.col(own_h)) & F.col("doc_id").eqNullSafe(F.col(own_k)))
    return out.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(h, own_h, own_k, n)
