"""Importance resampling towards a target: documents drawn by how much more often the target uses their n-grams.

Features of a text are its runs of 1 to GRAM consecutive words, each hashed
into one of BUCKETS. A task takes the texts of a slice as one sequence of word
ids with an end after each, and sorts its suffixes by their first GRAM words.
The common prefixes of neighbours then show the runs of equal n-grams: one for
each distinct n-gram of the slice, which is hashed once, its checksum carried
on from the run of its first n - 1 words, and counted by the run's length. To
score, the gains of the runs' buckets are scattered back to the places where
their n-grams begin and summed by document. Texts are read twice, once for the
counts of all and once to score, as ids of all features would take about as
much space as the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedseek.llm import shingles
from fedseek.llm.common import before_blocks, ordered, stored

BUCKETS, GRAM = 10_000, 2
#: Documents under this many words are not drawn; percent of the others that are; seed of the draw.
WORDS, PERCENT, SEED = 20, 25, 7

#: Bytes of a text in lower case; what is no part of a word becomes a blank. Bytes from 0x80 on are parts of letters.
_KEPT = np.full(256, 0x20, dtype=np.uint8)
_KEPT[0x30:0x3A] = np.arange(0x30, 0x3A)
_KEPT[0x61:0x7B] = _KEPT[0x41:0x5B] = np.arange(0x61, 0x7B)
_KEPT[0x80:] = np.arange(0x80, 0x100)


def plain(texts: pa.Array) -> pa.Array:
    """texts with blanks between their words and nothing else besides; null: empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    kept = _KEPT[np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]] if data else np.zeros(0, dtype=np.uint8)
    # offsets from 0 on: Arrow's lower case reads beyond the data of an array that begins later
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at - at[0]), pa.py_buffer(kept)])


class Suffixes:
    """The suffixes of texts as word ids, sorted by their first `gram` words, with the runs of equal n-grams.

    starts: where each text begins among the ids, which end each text with 0.
    """

    def __init__(self, texts: pa.Array, gram: int = GRAM):
        row, code, vocabulary = shingles.words(plain(texts))
        self.words = np.bincount(row, minlength=len(texts))
        self.starts = np.cumsum(self.words + 1) - self.words - 1
        ids = np.zeros(len(row) + len(texts), dtype=np.int64)
        ids[np.arange(len(row)) + row] = code.astype(np.int64) + 1
        self.vocabulary = [w.encode() for w in vocabulary.to_pylist()]
        kinds = len(self.vocabulary) + 1
        # ids of the n-th words; after an end there is nothing
        shifted = [ids]
        for j in range(1, gram):
            after = np.append(ids[j:], np.zeros(min(j, len(ids)), dtype=np.int64))
            shifted.append(np.where(shifted[-1] > 0, after, 0))
        key = ids
        for j in range(1, gram):
            if j > 1:  # so that keys stay small
                key = np.unique(key, return_inverse=True)[1]
            key = key * kinds + shifted[j]
        self.at = np.argsort(key)
        self.by_place = [x[self.at] for x in shifted]
        #: words that a suffix has in common with the one before
        self.common = np.zeros(len(ids), dtype=np.int64)
        same = np.ones(max(len(ids) - 1, 0), dtype=bool)
        for x in self.by_place:
            same &= (x[1:] == x[:-1]) & (x[1:] > 0)
            self.common[1:] += same

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1, 2, ...: places of n-grams in order of their suffixes, run of each, checksum of each run."""
        crc, run_of = np.zeros(1, dtype=np.int64), np.zeros(len(self.at), dtype=np.int64)
        for n, x in enumerate(self.by_place, 1):
            some = np.flatnonzero(x > 0)
            first = self.common[some] < n
            first[:1] = True  # the first n-gram begins a run
            heads = some[first]
            sep = b" " if n > 1 else b""
            follow = [sep + w for w in self.vocabulary]
            crc = np.fromiter(map(zlib.crc32, map(follow.__getitem__, (x[heads] - 1).tolist()), crc[run_of[heads]].tolist()), dtype=np.int64, count=len(heads))
            own = np.cumsum(first) - 1
            run_of = np.zeros(len(self.at), dtype=np.int64)
            run_of[some] = own
            yield self.at[some], own, crc

    def counts(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, dtype=np.int64)
        for _, run, crc in self.runs():
            np.add.at(out, crc % buckets, np.bincount(run, minlength=len(crc)))
        return out

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Sum of the gains of each text's features."""
        scattered = np.zeros(len(self.at), dtype=np.int64)
        for at, run, crc in self.runs():
            scattered[at] += gains[crc % len(gains)][run]
        return np.add.reduceat(scattered, self.starts) if len(self.starts) else scattered[:0]


def counted(texts: DataFrame, buckets: int = BUCKETS, gram: int = GRAM) -> np.ndarray:
    """Features of all texts (text) by bucket. A task adds up what it reads; what meets is `buckets` sums of each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in shingles.slices(batch, "text"):
                total += Suffixes(part.column("text"), gram).counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much more often the target has a bucket, smoothed by one feature of each; rounded down."""
    k = len(source)
    return np.floor(1000 * np.log((target + 1.0) * (source.sum() + k) / ((source + 1.0) * (target.sum() + k)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_features, weight: the mean gain of a document's features, rounded down; 0 without any."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shingles.slices(batch, "text"):
                found = Suffixes(part.column("text"), gram)
                n = sum(np.maximum(found.words - j, 0) for j in range(gram))
                mean = found.sums(gain) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.words), pa.array(n), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, gram: int = GRAM, words: int = WORDS, percent: int = PERCENT, seed: int = SEED, rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_features, weight, score, rank of docs (doc_id, text): a draw without replacement in proportion to weights.

    The score is the weight plus a Gumbel variable that depends on seed and
    doc_id only. Of the documents with at least `words` words, `percent` in a
    hundred, rounded down, have a rank: 1 for the highest score; the smaller
    doc_id goes first (null last, and its variable is that of an empty id),
    then the fewer features. Others have a null rank. Rows that repeat a
    document count and are drawn each by itself. Null and empty texts have no
    features and weight 0. Without target texts all gains follow from the
    smoothing. Other columns are not looked at; texts are read whole.
    """
    gain = gains(counted(docs, buckets, gram), counted(target, buckets, gram))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighted(docs, gain, gram).withColumn("score", F.col("weight") + gumbel))
    drawn, other = scored.where(F.col("n_words") >= words), scored.where(F.col("n_words") < words)
    lined = ordered(drawn, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")], rows)
    before, n = before_blocks(lined)
    take = n * percent // 100
    place = F.col("before") + F.col("pos") + 1
    lined = lined.join(F.broadcast(before), "block").withColumn("rank", F.when(place <= take, place))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return lined.select(columns).unionByName(other.withColumn("rank", F.lit(None).cast("bigint")).select(columns))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedseek.llm.common import documents

    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FEATURES = "SELECT {id}unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM {t}"

#: crc32 of each distinct feature's bytes, bit by bit.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
wanted AS (SELECT coalesce({_WORDS}, []) AS ws FROM benchmark),
features AS ({_FEATURES.format(id="rid, ", t="docs")}),
aimed AS ({_FEATURES.format(id="", t="wanted")}),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 10000 AS b
    FROM (SELECT f FROM features UNION SELECT f FROM aimed)),
s AS (SELECT b, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM aimed JOIN hashed USING (f) GROUP BY b),
gains AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((SELECT count(*) FROM features) + 10000)::double
    / ((coalesce(s.n, 0) + 1)::double * ((SELECT count(*) FROM aimed) + 10000)::double)))::bigint AS gain FROM (SELECT DISTINCT b FROM hashed) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weights AS (SELECT rid, floor(sum(gain)::double / count(*))::bigint AS weight, count(*) AS n_features FROM features JOIN hashed USING (f) JOIN gains USING (b) GROUP BY rid),
scored AS (SELECT doc_id, len(ws) >= 20 AS whole, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5)::double / 4294967296)))::bigint AS score
    FROM docs LEFT JOIN weights USING (rid)),
lined AS (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY score DESC, doc_id NULLS LAST, n_features) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN whole AND n <= (SELECT count(*) FROM scored WHERE whole) * 25 // 100 THEN n END AS rank FROM lined
"""
