"""Removal of repeated byte strings by Burrows-Wheeler transform and common prefixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier.
Every string of LENGTH bytes has a minimizer: the least hash of its GRAM-byte
strings. Equal strings have equal minimizers, so the runs of neighbouring
strings with one minimizer (segments) are dealt out by it, and each share of
the work is a collection of short strings: what the column-wise construction
(see bwt.py) is made for. In the order of suffixes, equal strings of LENGTH
bytes stand together, with common prefixes of LENGTH or more between them; all
but the first by document and place are marked. A document is a doc_id with a
text.

Before bytes are moved, minimizers that occur once are left out, as nothing
can equal their strings, and equal segments are reduced to the first of them,
the others being marked whole: a passage in a third of all documents is one
segment for the transform. A minimizer with one distinct segment is left out
too, unless it occurs in it twice; of the others, segments with which no other
shares what stands on either side of the minimizer. A minimizer with over CROWD distinct
segments, such as that of a phrase which many texts go on from differently,
would make one share too large: its segments are cut into their single strings,
and equal ones are reduced to the first by an aggregate, which leaves the
transform nothing to find there.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedseek.llm.bwt import collection
from fedseek.llm.common import dropped, stored
from fedseek.llm.shingles import M1, M2, M3, finish, slices

LENGTH, GRAM = 100, 40
#: Bytes of segments of one share of the transform's work, and rows of ids that may be sent to all tasks.
SHARE, SENT = 1 << 20, 1_000_000
#: Bytes of texts that are hashed in one call.
TOGETHER = 1 << 17
#: Hash of each byte.
BYTE = finish(np.arange(1, 257, dtype=np.uint64))
#: Distinct segments of one minimizer that may be in one share.
CROWD = 2000


def _pair(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """Hash of what a[i] and b[i + by] stand for; shorter by what does not fit."""
    n = min(len(a), len(b) - by)
    x = a[:n] * M1 + b[by : by + n] * M2
    return x ^ (x >> np.uint64(31))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of width."""
    done, m = 1, x
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments(b: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(minimizer, hash of the segment, text, start, strings, twice) of the segments of the texts that stand in b one after the other up to ends.

    A segment is of one text; a text shorter than length has none. gram is 40:
    hashes of 40 bytes are built from those of 32 and 8.
    """
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    count = np.maximum(ends - begin - length + 1, 0)
    if not count.sum():
        return tuple(np.zeros(0, dtype=k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    by = {1: BYTE[b]}
    for n in (2, 4, 8, 16, 32):
        by[n] = _pair(by[n // 2], by[n // 2], n // 2)
    g = _pair(by[32], by[8], 32) * M3
    width = length - gram + 1
    least = _least(g, width)
    # strings within one text: their places, and where each text has its first among them
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(ends)), count)
    inside = np.arange(len(text)) + (begin - first)[text]
    own = least[inside]
    # a new segment where the minimizer or the text changes, and after `width` strings
    change = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (text[1:] != text[:-1])) + 1])
    sizes = np.diff(np.append(change, len(own)))
    parts = -(-sizes // width)
    part = np.repeat(change, parts) + width * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    n = np.diff(np.append(part, len(own)))
    start = inside[part]
    size = n + length - 1

    def at(i: np.ndarray) -> np.ndarray:
        """Hash of the 64 bytes from i on."""
        x = by[32][i] * M1 + by[32][i + 32] * M2
        return x ^ (x >> np.uint64(31))

    hashed = finish(finish(finish(at(start) + size.astype(np.uint64) * M1) + at(start + (size - 64) // 2) * M2) + at(start + size - 64))
    # places that are a minimizer of some string: equal ones close together mean that a segment may hold a string twice
    high = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint64)
    high[inside + width - 1] = own
    chosen = np.flatnonzero(~_least(~high, width) == g)
    near = np.flatnonzero((g[chosen[1:]] == g[chosen[:-1]]) & (np.diff(chosen) < 2 * width))
    one = np.searchsorted(ends, chosen[near], "right")
    same = one == np.searchsorted(ends, chosen[near + 1], "right")
    near, one = near[same], one[same]
    flag = np.zeros(len(own) + 1, dtype=np.int64)
    low, top = first[one], first[one] + count[one]
    np.add.at(flag, np.clip(chosen[near] - 2 * width - begin[one] + low, low, top), 1)
    np.add.at(flag, np.clip(chosen[near + 1] + width - begin[one] + low, low, top), -1)
    twice = np.maximum.reduceat(np.cumsum(flag)[:-1], part) > 0
    return own[part], hashed, text[part], start - begin[text[part]], n, twice


def _strings(b: np.ndarray, length: int) -> np.ndarray:
    """Hash of each string of length bytes."""
    power, at, out = BYTE[b], 0, None
    n = 1
    while n <= length:
        if length & n:
            part = power[at : at + len(b) - length + 1]
            out = finish(part if out is None else finish(out) * M1 + part)
            at += n
        n *= 2
        if n <= length:
            power = _pair(power, power, n // 2)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            column = part.column("text").cast(pa.large_binary())
            _, offsets, data = column.buffers()
            ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            b, ends = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]
            # short texts together, as each call costs as much as some thousand bytes
            cut = np.flatnonzero(np.diff(ends[1:] // TOGETHER, prepend=ends[1] // TOGETHER))
            out = []
            for lo, hi in zip([0, *cut], [*cut, len(column)], strict=True):
                m, h, text, *rest = segments(b[ends[lo] : ends[hi]], ends[lo + 1 : hi + 1] - ends[lo])
                out.append((m, h, text + lo, *rest))
            m, h, text, s, n, t = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(m):
                own = pa.array(text)
                doc, k = part.column("doc_id").take(own), part.column("k").take(own)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(h.view(np.int64)), doc, k, pa.array(s << 8 | n << 1 | t)], names=["m", "h", "doc_id", "k", "at"])


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """m, c of each slice: the segments of each minimizer; one that may hold a string twice counts as two."""
    for found in _scan(batches):
        m, which = np.unique(found.column("m").to_numpy(), return_inverse=True)
        c = np.bincount(which, weights=1 + (found.column("at").to_numpy() & 1), minlength=len(m)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(c)], names=["m", "c"])


def _alike(pdf: pd.DataFrame, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Whether a segment (m, bytes) may share a string with another of its minimizer, or hold one twice.

    A shared string has its minimizer at one place in both, and half of its
    other bytes at least stand on one side of it: so one of the two sides of
    some minimizer in the segment is found beside another of them.
    """
    text, m = np.frombuffer(b"".join(pdf["bytes"]), dtype=np.uint8), pdf["m"].to_numpy().view(np.uint64)
    size = pdf["bytes"].str.len().to_numpy(dtype=np.int64)
    end = np.cumsum(size)
    by = {1: BYTE[text]}
    for n in (2, 4, 8, 16, 32):
        by[n] = _pair(by[n // 2], by[n // 2], n // 2)
    g = _pair(by[32], by[8], 32) * M3
    at = np.flatnonzero(g == np.repeat(m, size)[: len(g)])
    own = np.searchsorted(end, at, "right")
    at, own = (x[at + gram <= end[own]] for x in (at, own))
    half = (length - gram) // 2  # 30 bytes, which two of 16 that overlap cover
    out = np.zeros(len(pdf), dtype=bool)
    for side, inside in ((at - half, at - half >= end[own] - size[own]), (at + gram, at + gram + half <= end[own])):
        side, of = side[inside], own[inside]
        h = finish(m[of] * M1 + finish(by[16][side] * M2 + by[16][side + half - 16]))
        _, which, n = np.unique(h, return_inverse=True, return_counts=True)
        out[of[n[which] > 1]] = True
    return out


def _marked(pdf: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """Strings of these segments (m, doc_id, k, start, bytes) that also start earlier: doc_id, k, start, n. Segments that are not _alike have none and are left out of the transform."""
    pdf = pdf[_alike(pdf, length)]
    text = np.frombuffer(b"".join(pdf["bytes"]), dtype=np.uint8)
    size = pdf["bytes"].str.len().to_numpy(dtype=np.int64)
    first = np.cumsum(size) - size
    with tempfile.TemporaryDirectory() as folder:
        _, common, place = collection(text, first, size, length, folder)
    group = np.cumsum(common < length)
    many = np.bincount(group)[group] > 1
    group, place = group[many], place[many]
    own = np.searchsorted(first, place, "right") - 1
    doc, k, start = pdf["doc_id"].to_numpy()[own], pdf["k"].to_numpy()[own], pdf["start"].to_numpy()[own] + place - first[own]
    order = np.lexsort((start, k, doc, group))
    group, doc, k, start = group[order], doc[order], k[order], start[order]
    head = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=bool)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0)) if len(group) else np.zeros(0, dtype=np.int64)
    later = (doc != doc[lead]) | (k != k[lead]) | (start != start[lead])  # rows that repeat a document are no earlier place
    return pd.DataFrame({"doc_id": doc[later], "k": k[later], "start": start[later].astype(np.int64), "n": np.ones(int(later.sum()), dtype=np.int64)})


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs (doc_id, text; text not null) as doc_id, k, text, own_id, and whether rows repeat a document.

    doc_id and k name a document, and their order is (doc_id is null, doc_id,
    hash of text): a null doc_id is the largest number with a k from 0 on, and
    k is below 0 for others. An id with one text has the same k as all such,
    which costs nothing where keys are moved; others have the hash of the text.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "text", F.col("doc_id").alias("own_id"))
    h = F.xxhash64("text")
    per = docs.select("own_id", h.alias("h")).groupBy("own_id").agg(F.count("*").alias("rows"), (F.min("h") != F.max("h")).alias("differ"))
    per = stored(per.where("rows > 1 or own_id is null"))
    differ = per.where("differ and own_id is not null").select(F.col("own_id").alias("d"))
    n, repeat = per.agg(F.count_if(F.col("differ") & F.col("own_id").isNotNull()), F.coalesce(F.max("rows"), F.lit(0)) > 1).first()
    hashed = h.bitwiseOR(F.lit(-(2**63)))
    if not n:
        hashed = F.lit(-1).cast("long")
    elif n <= SENT:
        docs = docs.join(F.broadcast(differ), F.col("own_id") == F.col("d"), "left")
        hashed = F.when(F.col("d").isNotNull(), hashed).otherwise(F.lit(-1).cast("long"))
    k = F.when(F.col("own_id").isNull(), h.bitwiseAND(F.lit(2**63 - 1))).otherwise(hashed)
    return docs.select("doc_id", k.alias("k"), "text", "own_id"), repeat


def cuts(docs: DataFrame, length: int = LENGTH, repeat: bool = True) -> DataFrame:
    """doc_id, k, start, n: from start on, n neighbouring strings of `length` bytes also start earlier. docs: doc_id, k, text, none null; repeat: whether rows may repeat a document."""
    found = docs.mapInArrow(_scan, "m bigint, h bigint, doc_id bigint, k bigint, at bigint")
    often = docs.mapInArrow(_minimizers, "m bigint, c bigint").groupBy("m").agg(F.sum("c").alias("c")).where("c > 1").select("m")
    often = stored(often)  # a join of plain shuffles, unlike one of an aggregate, is split where one m is hot
    kept = stored(found.join(often, "m").select("m", "h", "doc_id", "k", F.shiftright("at", 8).alias("start"), F.shiftright("at", 1).bitwiseAND(F.lit(127)).alias("n"), (F.col("at").bitwiseAND(F.lit(1)) == 1).alias("twice")))
    first = stored(kept.groupBy("m", "h").agg(F.min(F.struct("doc_id", "k", "start", "n")).alias("f"), F.max("twice").alias("twice")))
    is_later = (F.col("doc_id") != F.col("f.doc_id")) | (F.col("k") != F.col("f.k")) | (F.col("start") != F.col("f.start"))
    repeats = kept.join(first.select("m", "h", "f"), ["m", "h"]).where(is_later).select("doc_id", "k", "start", "n")
    open_m = stored(first.groupBy("m").agg(F.count("*").alias("c"), F.max("twice").alias("t")).where("c > 1 or t").select("m", "c"))
    wanted = stored(first.join(open_m, "m").select("m", "f.doc_id", "f.k", "f.start", F.col("f.n").alias("n"), (F.col("c") > CROWD).alias("crowd")))
    dropped(often, open_m)
    places = wanted.groupBy("doc_id", "k").agg(F.collect_list(F.struct("m", "start", "n", "crowd")).alias("places"))  # of one document
    total, ids, crowds = wanted.agg(F.coalesce(F.sum(F.col("n") + length - 1), F.lit(0)), F.approx_count_distinct("doc_id"), F.count_if("crowd")).first()
    # few documents: their ids go to all tasks, and only their texts move; many: a join moves all texts
    own = docs.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi") if ids <= SENT else docs
    own = own.dropDuplicates(["doc_id", "k"]) if repeat else own
    own = own.join(places, ["doc_id", "k"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, doc, key, start, out = [], [], [], [], []
            for d, k, text, all_ in zip(batch.column("doc_id").to_pylist(), batch.column("k").to_pylist(), batch.column("text"), batch.column("places"), strict=True):
                b = text.as_py().encode()
                for x in all_.as_py():
                    if not x["crowd"]:
                        m.append(x["m"])
                        doc.append(d)
                        key.append(k)
                        start.append(x["start"])
                        out.append(b[x["start"] : x["start"] + x["n"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(out, pa.binary())], names=["m", "doc_id", "k", "start", "bytes"])

    def fetch_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, k, text, all_ in zip(batch.column("doc_id").to_pylist(), batch.column("k").to_pylist(), batch.column("text"), batch.column("places"), strict=True):
                b = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                crowd = [x for x in all_.as_py() if x["crowd"]]
                if crowd:
                    h = [_strings(b[x["start"] : x["start"] + x["n"] + length - 1], length) for x in crowd]
                    sizes = [len(x) for x in h]
                    m = np.repeat(np.array([x["m"] for x in crowd], dtype=np.int64), sizes)
                    start = np.concatenate([x["start"] + np.arange(n) for x, n in zip(crowd, sizes, strict=True)])
                    yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(np.concatenate(h).view(np.int64)), pa.array(np.full(len(m), d)), pa.array(np.full(len(m), k)), pa.array(start)], names=["m", "h", "doc_id", "k", "start"])

    moved = own.mapInArrow(fetch, "m bigint, doc_id bigint, k bigint, start bigint, bytes binary")
    shares = max(1, -(-total // SHARE))
    marked = moved.groupBy(F.expr(f"pmod(xxhash64(m), {shares})").alias("share")).applyInPandas(lambda pdf: _marked(pdf, length), "doc_id bigint, k bigint, start bigint, n bigint")
    found = repeats.unionByName(marked)
    if crowds:
        strings = stored(own.where(F.exists("places", lambda x: x.crowd)).mapInArrow(fetch_strings, "m bigint, h bigint, doc_id bigint, k bigint, start bigint"))
        place = F.struct("doc_id", "k", "start")
        heads = strings.groupBy("m", "h").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f != l").select("m", "h", "f")
        found = found.unionByName(strings.join(heads, ["m", "h"]).where(place != F.col("f")).select("doc_id", "k", "start", F.lit(1).cast("long").alias("n")))
    return found


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of docs (doc_id, text) with kept: binary, what is left of the UTF-8 bytes, and n_bytes, n_removed, n_spans, kept_sha256.

    A null or empty text, or one shorter than `length` bytes, keeps all its
    bytes. doc_id with the text is the key: rows that repeat both are one
    document and get one result, rows that repeat a doc_id with another text
    or have none are documents of their own. Strings are judged on the input;
    the first by (doc_id, null last, hash of text, start) stays.
    """
    docs, repeat = _keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    found = cuts(docs.where(F.octet_length("text") >= length).select("doc_id", "k", "text"), length, repeat)
    gather = F.collect_set if repeat else F.collect_list  # a document that many rows repeat has each cut once
    per = found.groupBy("doc_id", "k").agg(gather(F.struct("start", "n")).alias("cuts"))  # of one document
    rows = docs.join(per, ["doc_id", "k"], "left").select("own_id", "text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, c in zip(batch.column("text"), batch.column("cuts"), strict=True):
                b = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                edge = np.zeros(len(b) + 1, dtype=np.int32)
                if c.is_valid:
                    start, n = c.values.field(0).to_numpy(), c.values.field(1).to_numpy()
                    np.add.at(edge, np.minimum(start, len(b)), 1)
                    np.add.at(edge, np.minimum(start + n + length - 1, len(b)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                out.append((kept, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("own_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(cut, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedseek.llm.common import documents

    return removed(documents(spark, sf_dir)).drop("kept")


#: The same from every string of LENGTH bytes, in hexadecimal digits.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS i FROM d),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS s FROM p),
f AS (SELECT s, min((doc_id, i)) AS first FROM w GROUP BY s HAVING count(*) > 1),
m AS (SELECT w.doc_id, w.i, w.i > lag(w.i, 1, -{LENGTH + 1}) OVER (PARTITION BY w.doc_id ORDER BY w.i) + {LENGTH} AS new FROM w JOIN f ON w.s = f.s WHERE (w.doc_id, w.i) <> f.first),
n AS (SELECT doc_id, i, sum(new::int) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM n GROUP BY doc_id, span),
k AS (SELECT d.doc_id, r.a, substr(d.x, 2 * lag(r.b, 1, 0) OVER o + 1, 2 * (coalesce(r.a, length(d.x) // 2) - lag(r.b, 1, 0) OVER o)) AS before, lead(r.a) OVER o IS NULL AS last, r.b, d.x
 FROM d LEFT JOIN r ON d.doc_id = r.doc_id WINDOW o AS (PARTITION BY d.doc_id ORDER BY r.a)),
t AS (SELECT *, before || CASE WHEN last AND b IS NOT NULL THEN substr(x, 2 * b + 1) ELSE '' END AS keeps FROM k)
SELECT doc_id, any_value(length(x)) // 2 AS n_bytes, any_value(length(x)) // 2 - sum(length(keeps))::bigint // 2 AS n_removed, count(a) AS n_spans,
 sha256(unhex(coalesce(string_agg(keeps, '' ORDER BY a), ''))) AS kept_sha256 FROM t GROUP BY doc_id
"""
