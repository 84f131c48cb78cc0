import math
import re
import zlib
from collections import Counter

import helpers as H
import numpy as np

from pyspark.sql import functions as F

from fedseek.llm import language_model as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def brute(docs):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    c = Counter(t for i, x in docs if not held[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(t := tokens(x)), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, x in docs}


def agree(rows, docs):
    want = brute(docs)
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))
        assert r.score < 0 and math.isfinite(r.score)


def test_base_and_better_than_base(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{H.D}/documents.parquet").collect()]
    rows = lm.op4_lm_scores(spark, H.D).collect()
    agree(rows, docs)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edges_with_a_small_model(spark):
    texts = ["", None, "Ünïcode WORD word", " \t\x0b ", "a a a b", "never seen é" * 3, "x" * 10000, *(H.words(50, i, 30) for i in range(30))]
    docs = H.frame(spark, texts).withColumnsRenamed({"source": "k", "lang": "word", "n_chars": "score"})
    agree(lm.scored(docs, own=5, rare=3, known=7).collect(), list(enumerate(texts)))
    assert lm.scored(docs.limit(0), own=5, rare=3).count() == 0
    twice = lm.scored(docs.union(docs), own=5, rare=3, known=7)
    assert twice.groupBy("doc_id").count().where("count != 2").count() == 0
    assert twice.groupBy("doc_id").agg({"score": "stddev"}).where("`stddev(score)` > 1e-9").count() == 0
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert lm.scored(none, own=5, rare=3).where("not held_out").count() == len(texts)


def keyed(docs):
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.coalesce("text", F.lit("")).alias("text"))


def plain(m, before, y):
    """log-probability of unit y after the units `before`, by sums over every band and unit."""
    q = sum(m.context[u].astype(float) * m.position[j] for j, u in enumerate(before))
    band = lambda g: q @ m.band[g] + m.band_bias[g]
    unit = lambda u: q @ m.unit[u] + m.unit_bias[u]
    g = y // m.size
    bands = math.log(sum(math.exp(band(x)) for x in range(len(m.band))))
    units = math.log(sum(math.exp(unit(u)) for u in range(g * m.size, min((g + 1) * m.size, len(m.unit)))))
    return band(g) - bands + unit(y) - units


def test_scores_by_plain_sums(spark):
    """Every score from the fitted model and word counts, word by word; and the mass of all words, of one unseen word of each rare unit and of the end is 1."""
    texts = [None, "", "new newer unseen", *(H.words(25, i, 40) for i in range(40))]
    docs = H.frame(spark, texts).select("doc_id", "text")
    f = lm.fit(keyed(docs), own=9, rare=3, known=12, often=2, size=4)
    c = {r.word: r.c for r in f.counts.collect()}
    own = {w: i + 1 for i, w in enumerate(sorted(c, key=lambda w: (-c[w], w))[: f.own])}
    unit = lambda w: 0 if w is None else own.get(w) or 1 + f.own + lm.rare_class(w, 3)
    share = [0.5 + sum(n + 0.5 for w, n in c.items() if w not in own and lm.rare_class(w, 3) == r) for r in range(3)]

    def word(before, w):
        y = unit(w)
        inner = math.log((c.get(w, 0) + 0.5) / share[y - 1 - f.own]) if y > f.own else 0.0
        return plain(f.model, before, y) + inner

    got = {r.doc_id: r.score for r in lm.scored(docs, own=9, rare=3, known=12, often=2, size=4).collect()}
    for i, x in enumerate(texts):
        before, total = [0] * lm.CONTEXT, 0.0
        for w in tokens(x):
            total += word(before, w)
            before = [unit(w), *before[:-1]]
        assert abs(got[i] - total / math.log(10)) < 1e-4 * max(1, len(tokens(x)))
    for before in ([0, 0, 0], [3, 12, 0], [1, 2, 3]):
        unseen = sum(math.exp(plain(f.model, before, 1 + f.own + r)) * 0.5 / share[r] for r in range(3))
        assert abs(sum(math.exp(word(before, w)) for w in [None, *c]) + unseen - 1) < 1e-4


def test_training_moves_towards_what_follows():
    """After unit 1 comes 2, after 3 comes 4: training finds it, and one round of two halves, summed, is the same in any order."""
    r = np.random.default_rng(3)
    first = r.choice([1, 3], 4000)
    seq = np.stack([first, first + 1], axis=1).ravel()
    before = np.zeros((len(seq), lm.CONTEXT), dtype=np.int64)
    before[1:, 0] = seq[:-1]
    m = lm.Bilinear.start(np.bincount(seq, minlength=6).astype(float))
    t = lm.Trainer(m, 0.1)
    for _ in range(20):
        t.step(before, seq, r)
    lp = t.m.log_probability(np.array([[1, 0, 0], [3, 0, 0]]), np.array([2, 4]))
    assert (lp > m.log_probability(np.array([[1, 0, 0], [3, 0, 0]]), np.array([2, 4])) + 0.3).all()
    every = t.m.log_probability(np.tile([[1, 3, 2]], (6, 1)), np.arange(6))
    assert abs(np.exp(every).sum() - 1) < 1e-5


def test_pieces_keep_what_stands_before():
    size, lm.PIECE = lm.PIECE, 4
    try:
        texts = [[5, 6, 7, 8, 9, 10, 11, 12, 0], [0], [3, 0], [1, 2, 3, 0]]
        pieces = [p for k, t in enumerate(texts) for p in lm._pieces(k, np.array(t))]
        assert [(k, i) for k, i, _ in pieces] == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (3, 0)]
        before, seq = lm._joined([x for *_, x in pieces])
    finally:
        lm.PIECE = size
    want = [([*reversed([0, 0, 0, *t][i : i + 3])], u) for t in texts for i, u in enumerate(t)]
    assert list(zip(before.tolist(), seq.tolist(), strict=True)) == want


def test_what_is_learned_does_not_depend_on_how_rows_are_dealt(spark):
    """The same documents in 1, 8 and 64 partitions, in other orders; and the model beats the base by 0.2 a token on held-out ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = []
    for n in (1, 8, 64):
        rows = lm.scored(docs.repartition(n, F.xxhash64("doc_id", F.lit(n)))).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        got.append((rows[0] / rows[2], rows[1] / rows[2]))
    assert max(s for s, _ in got) - min(s for s, _ in got) < 1e-6
    assert all(s > b + 0.2 for s, b in got)


def test_several_shards_and_waves_and_repeated_rows(spark):
    """Many shards in several waves, a document that stands so often that it is dealt over shards: scores are finite, and those of a rerun agree."""
    sizes = lm.SHARD, lm.REPEATS
    lm.SHARD, lm.REPEATS = 300, 20
    try:
        docs = H.frame(spark, [H.words(60, i, 80) for i in range(60)]).select("doc_id", "text")
        docs = docs.unionByName(spark.createDataFrame([(7, H.words(60, 7, 80))] * 100, "doc_id long, text string"))
        runs = [sorted((r.doc_id, round(r.score, 3)) for r in lm.scored(docs.repartition(n)).collect()) for n in (2, 9)]
        assert runs[0] == runs[1]
        assert all(math.isfinite(s) and s < 0 for _, s in runs[0])
    finally:
        lm.SHARD, lm.REPEATS = sizes


def test_work_of_a_step_is_not_by_band(monkeypatch):
    """Bands cost a step no more than products of matrices; and the step is the one of plain sums over its tokens and noise."""
    calls, sigmoid = [], lm._sigmoid
    monkeypatch.setattr(lm, "_sigmoid", lambda x: calls.append(1) or sigmoid(x))
    r = np.random.default_rng(5)
    m = lm.Bilinear.start(r.integers(1, 50, 403).astype(float), size=8)
    m.unit[:] = r.normal(0, 1, m.unit.shape)
    m.context[:] = r.normal(0, 1, m.context.shape)
    seq, before = r.integers(0, 403, 500), r.integers(0, 403, (500, lm.CONTEXT))
    t = lm.Trainer(m, 0.1)
    t.step(before, seq, np.random.default_rng(9))
    assert len(calls) < 8 < len(m.band)

    again = np.random.default_rng(9)
    again.random(lm.BAND_NOISE)
    groups = sorted(set(seq // 8))
    draws = again.random((len(groups), lm.UNIT_NOISE))
    s = lambda x: 1 / (1 + math.exp(-x))
    share = m.freq / np.repeat(np.add.reduceat(m.freq, np.arange(0, 403, 8)), 8)[:403]
    grad = np.zeros((403, lm.DIM + 1))
    for b, y in zip(before, seq, strict=True):
        q = np.append(sum(m.context[u].astype(float) * m.position[j] for j, u in enumerate(b)), 1)
        score = lambda u: q[:-1] @ m.unit[u] + m.unit_bias[u] - math.log(lm.UNIT_NOISE * share[u])  # noqa: B023, E731
        grad[y] += (1 - s(score(y))) * q
        first = y // 8 * 8
        for x in draws[groups.index(y // 8)]:
            u = first + int(np.searchsorted(np.cumsum(share[first : first + 8])[:-1], x))
            grad[u] -= s(score(u)) * q
    want = m.unit + 0.1 * grad[:, :-1] / np.sqrt(lm.EARLIER + (grad[:, :-1] ** 2).sum(1) / lm.DIM)[:, None]
    assert np.abs(t.m.unit - want).max() < 1e-4
    assert np.abs(t.m.unit_bias - m.unit_bias - 0.1 * grad[:, -1] / np.sqrt(lm.EARLIER_BIAS + grad[:, -1] ** 2)).max() < 1e-4


def test_probabilities_of_products_far_apart():
    """Rows beyond what exp has room for, beside others."""
    r = np.random.default_rng(2)
    m = lm.Bilinear.start(r.integers(1, 50, 60).astype(float), size=8)
    m.context[:20] *= 200
    m.unit[:], m.band[:] = m.unit * 40, m.band * 40
    before, seq = r.integers(0, 60, (300, lm.CONTEXT)), r.integers(0, 60, 300)
    got = m.log_probability(before, seq)
    assert all(abs(g - plain(m, b, y)) < 1e-3 * max(1, abs(g)) for g, b, y in zip(got, before, seq, strict=True))


def test_units_and_counts_of_words():
    import pyarrow as pa

    words, counts = ["é", "ab", "", "日本語", "x"], np.array([9, 7, 5, 3, 1])
    asked = ["x", "日本語", "zz本語", "ab", "b", "é", "aé"]
    unit, count = lm.Units(pa.array(words), counts, 2, 5).of(pa.array(asked))
    assert count.tolist() == [counts[words.index(w)] if w in words else 0 for w in asked]
    assert unit.tolist() == [words.index(w) + 1 if w in words[:2] else 3 + lm.rare_class(w, 5) for w in asked]
    assert lm.Units(pa.array([], pa.string()), np.zeros(0, dtype=np.int64), 0, 5).of(pa.array(["q"]))[1].tolist() == [0]
