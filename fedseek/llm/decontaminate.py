"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may stand in a document with up to
e = floor(m * RATE) edits. Of e + 1 pieces of the item at least one is then
untouched. One automaton of all pieces scans each whole document; around each
piece hit the item is compared with the stretch of the document that it can
cover, by Myers' bit-parallel edit distance, one machine-independent integer
per column. Items come in blocks of bounded size, each with a pass of its own
over the documents, so what is sent to the tasks does not grow with the
benchmark.

An item under SHORTEST characters says little when edited, so it is looked for
without errors and where it begins and ends with a word. Texts are compared in
lower case with runs of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedseek.llm.common import free_name, stored

RATE, SHORTEST = 0.05, 40
#: Characters of items that one pass over the documents looks for.
BLOCK_CHARS = 1_000_000


#: Code points of scripts written without spaces, where any character may begin a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def one_word(a: str, b: str) -> bool:
    """Whether the neighbours a and b are characters of one word."""
    return a.isalnum() and b.isalnum() and not any(lo <= ord(x) <= hi for x in (a, b) for lo, hi in UNSPACED)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces (offset, string) that cover item, as equal in length as can be."""
    n = errors + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def best_match(masks: dict[str, int], m: int, text: str, errors: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the pattern that ends in text, the first of equal ones; None beyond errors.

    masks: for each character its places in the pattern as bits.
    """
    high, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score, best = full, 0, m, None
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full  # a match may start anywhere: the top row is 0
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score <= errors and (best is None or score < best[0]):
            best = (score, i + 1)
    return best


class Matcher:
    """Finds items in one text; built in each task from a bounded block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float, shortest: int):
        import ahocorasick

        self.items, self.auto = [], ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            errors = int(len(text) * rate) if len(text) >= shortest else 0
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            for at, piece in pieces(text, errors):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, len(text), errors, masks if len(text) >= shortest else None))
        for piece, places in where.items():
            self.auto.add_word(piece, (len(piece), places))
        self.auto.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of the best match of each item that text has within its error budget."""
        spans: dict[int, list[list[int]]] = {}
        short: dict[int, int] = {}
        for end, (size, places) in self.auto.iter(text):
            start = end + 1 - size
            for k, at in places:
                _, m, e, masks = self.items[k]
                if masks is None:
                    if k not in short and not (start and one_word(text[start - 1], text[start])) and not (end + 1 < len(text) and one_word(text[end], text[end + 1])):
                        short[k] = end + 1
                    continue
                lo, hi = max(0, start - at - e), min(len(text), start - at + m + e)
                own = spans.setdefault(k, [])
                # hits come in order of their ends, so stretches that meet are neighbours, but for a few
                if own and lo <= own[-1][1] and hi >= own[-1][0]:
                    own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                else:
                    own.append([lo, hi])
        out = [(self.items[k][0], 0, end) for k, end in short.items()]
        for k, own in spans.items():
            item_id, m, e, masks = self.items[k]
            best = None
            for lo, hi in own:
                found = best_match(masks, m, text[lo:hi], e)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], lo + found[1])
            if best:
                out.append((item_id, *best))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, h, item_id, distance, end: each item found in a document, with its best match.

    h is the hash of id and text, distance the edits, end the end of the match
    in the normal form. docs has doc_id, text; benchmark has item_id, text.
    Items with fewer than `shortest` characters in normal form are found
    without edits and as whole words only; null ones and those without text are
    in no document. Items of equal text are all reported, with the first of
    equally good matches. Null and empty documents contain nothing. Rows that
    repeat a document repeat its result; a null doc_id is a value like others.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, h bigint, item_id bigint, distance int, end int"
    # a hash deals the items into blocks of about block_chars; only one block at a time is with the driver
    sized = benchmark.select("item_id", "text").where("text is not null and item_id is not null").distinct()
    buckets = sized.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 20)))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-total // block_chars)
    found = None
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    for b in range(n_blocks):
        block = buckets.where(F.pmod("b", F.lit(n_blocks)) == b).select("item_id", "text").collect()
        items = [(r.item_id, x) for r in block if (x := normal(r.text))]
        if not items:
            continue

        def scan(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate, shortest)
            for batch in batches:
                ids, hs, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
                for i, text in enumerate(batch.column(2)):
                    if text := normal(text.as_py()):
                        out += [(ids[i], hs[i], *hit) for hit in matcher.hits(text)]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "h", "item_id", "distance", "end"])

        part = rows.mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the documents that contain an item; all columns as they were."""
    h, own_h, own = free_name(docs, "leak_h", "leak_own_h", "leak_doc")
    bad = stored(contaminated(docs, benchmark, **how).select("h", "doc_id").distinct()).toDF(own_h, own)
    return docs.withColumn(h, F.xxhash64("doc_id", "text")).join(bad, (F.col(h) == F.col(own_h)) & F.col("doc_id").eqNullSafe(F.col(own)), "left_anti").drop(h)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedseek.llm.common import documents

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("h")
