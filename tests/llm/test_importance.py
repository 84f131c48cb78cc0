import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, D, duck, frame, same, words

from fedseek.llm import shingles
from fedseek.llm.importance import ORACLE, Suffixes, gains, op11_importance, plain, resampled

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, gram=2):
    w = split(text)
    return [" ".join(w[i : i + n]) for n in range(1, gram + 1) for i in range(len(w) - n + 1)]


def bucket(f, k=10_000):
    return zlib.crc32(f.encode()) % k


def plainly(rows, target, percent=25, least=20):
    """The contract in plain Python over rows (doc_id, text)."""
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        f = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in map(bucket, features(x))]
        weight = sum(f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, len(split(x)) >= least])
    lined = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    take = percent * len(lined) // 100
    return sorted([(*r[:4], k if k <= take else None) for k, r in enumerate(lined, 1)] + [(*r[:4], None) for r in out if not r[4]], key=repr)


def ours(docs, target, **how):
    return sorted((tuple(r) for r in resampled(docs, target, **how).collect()), key=repr)


def test_matches_sql_at_small_scale(spark):
    got, want = same(op11_importance(spark, D), duck().sql(ORACLE))
    assert got == want
    assert sum(r[-1] is not None for r in got) > 10


def test_words_of_all_bytes():
    text = "".join(map(chr, range(0x250))) + " Ünï9x A_b　中文 é\x00z ÀB"
    assert [x for x in plain(pa.array([text, None, ""])).to_pylist()[0].split(" ") if x] == split(text)
    row, code, vocabulary = shingles.words(plain(pa.array([text])))
    assert vocabulary.take(pa.array(code)).to_pylist() == split(text)
    assert plain(pa.array(["x y", "Zw;", None]).slice(1)).to_pylist() == ["zw ", ""]


def test_words_of_a_part_of_an_array():
    texts = [words(40, i) + " é à ü" for i in range(200)]
    for lo in (0, 1, 60, 199, 200):
        part = plain(pa.array(texts).slice(lo, 50))
        assert part.to_pylist() == [x for x in texts[lo : lo + 50]]
        row, code, vocabulary = shingles.words(part)
        assert vocabulary.take(pa.array(code)).to_pylist() == [w for x in texts[lo : lo + 50] for w in x.split()]


@pytest.mark.parametrize("gram", [1, 2, 3, 4])
def test_runs_are_the_distinct_ngrams(gram):
    texts = [words(300, i, 30) for i in range(5)] + ["", None, "a", "a a a a a", "b a", words(50, 1, 5)]
    found = Suffixes(pa.array(texts), gram)
    for n, (at, run, crc) in enumerate(found.runs(), 1):
        want = Counter(" ".join(w[i : i + n]) for x in texts for w in [split(x)] for i in range(len(w) - n + 1))
        assert sorted(np.bincount(run, minlength=len(crc)).tolist()) == sorted(want.values())
        assert sorted(crc.tolist()) == sorted(zlib.crc32(f.encode()) for f in want)
        assert len(set(at.tolist())) == sum(want.values())
    k = 97
    want = np.bincount([bucket(f, k) for x in texts for f in features(x, gram)], minlength=k)
    assert (found.counts(k) == want).all()
    gain = np.arange(k) - 40
    assert found.sums(gain).tolist() == [sum(int(gain[bucket(f, k)]) for f in features(x, gram)) for x in texts]


def test_no_words_at_all():
    for texts in ([], [None, "", "--"]):
        found = Suffixes(pa.array(texts, pa.string()))
        assert found.counts(10).sum() == 0
        assert found.sums(np.ones(10, dtype=np.int64)).tolist() == [0] * len(texts)


def test_hard_rows(spark):
    """Nulls, empty and very long texts, a document that is a third of all rows, ids that repeat with other texts, many slices and blocks."""
    long = words(120_000, 3, 900)
    rows = [(i, words(10 + i % 40, i, 60)) for i in range(80)] + [(5, words(30, 77, 60))] * 40 + [(5, words(31, 78, 60)), (None, None), (None, words(25, 5, 60)), (9, ""), (200, long), (201, "É é A-b 中文" * 9)]
    target = [words(40, 500, 60), None, "", "w1 w2 w3"]
    docs = spark.createDataFrame([(i, x, "en", "s", 0, 1, 2, 3) for i, x in rows], DOCS + ", rank long, words long, block long").repartition(6)
    size, shingles.SLICE = shingles.SLICE, 2000
    try:
        assert ours(docs, frame(spark, target), rows=17) == plainly(rows, target)
    finally:
        shingles.SLICE = size


def test_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [words(30, i) for i in range(8)])
    assert ours(none, some) == []
    assert ours(none, none) == []
    assert ours(some, none) == plainly([(i, words(30, i)) for i in range(8)], [])


def test_gains_round_down():
    assert gains(np.array([0, 10]), np.array([10, 0])).tolist() == [math.floor(1000 * math.log(11)), math.floor(1000 * math.log(1 / 11))]
