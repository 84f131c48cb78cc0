import random
import re

import helpers as H
import numpy as np
import pytest

from fedseek.llm import graph, ngram_join


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k=3, num=90):
    sets = [(i, shingles(x, k)) for i, x in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and min(len(s), len(t)) * 100 >= num * max(len(s), len(t)) and 100 * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def texts():
    r = random.Random(8)
    out = [None, "", " \t", "one", "One", "one two", "two one", "a b c", "A B C", "a b c d", "İ ß x y", "a " * 500]
    for g in range(12):
        base = H.words(r.randrange(20, 400), g).split()
        for _ in range(r.randrange(1, 7)):
            x = list(base)
            for _ in range(r.randrange(0, 1 + len(x) // 25)):
                x[r.randrange(len(x))] = f"e{r.randrange(9999)}"
            out.append(" ".join(x))
    base = H.words(300, 77).split()
    for i in range(70):  # one large group of near copies
        x = list(base)
        x[r.randrange(300)] = f"v{i}"
        x[r.randrange(300)] = f"u{i}"
        out.append(" ".join(x))
    r.shuffle(out)
    return out


def got(spark, docs, **how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.grouped(H.frame(spark, docs), **how).collect()}


@pytest.mark.parametrize("how", [{}, {"k": 5, "num": 80}])
def test_against_all_pairs(spark, how):
    t = texts()
    want = brute(list(enumerate(t)), **how)
    assert got(spark, t, **how) == want
    assert any(i != c for i, (_, c) in want.items())


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 5000)
    t = texts()
    assert got(spark, t) == brute(list(enumerate(t)))


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{H.D}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op8_ngram_join(spark, H.D).collect()} == brute(docs)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (3, 2)]
    out = {r.u: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}}


def test_one_of_each(spark):
    a = H.words(100)
    docs = H.frame(spark, [a, a, None, "", a + " more", "other text of its own"]).withColumnRenamed("lang", "node")
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 5]
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, 10**6])
def test_rows_that_repeat_an_id(spark, monkeypatch, sent):
    monkeypatch.setattr(ngram_join, "SENT", sent)
    a, b = H.words(100), H.words(80, 2)
    rows = [(1, a)] * 5 + [(1, b), (2, a + " x"), (3, b + " y"), (4, H.words(50, 3)), (None, a + " z"), (None, a)]
    out = ngram_join.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 1), (None, None)}


@pytest.mark.parametrize("sent", [0, 10**6])
def test_one_of_each_without_ids_and_with_repeated_ones(spark, monkeypatch, sent):
    monkeypatch.setattr(ngram_join, "SENT", sent)
    a, b, c, d = (H.words(100, i) for i in range(4))
    rows = [(1, a, "x"), (1, a, "y"), (1, b, "x"), (2, a + " x", "x"), (None, a, "x"), (None, a + " z", "x")]
    rows += [(None, c, "x")] * 40 + [(None, c + " near", "x"), (None, "", "x"), (None, "", "x"), (None, None, "x"), (3, " ", "x"), (3, " ", "x")]
    rows += [(4, d + " one", "x"), (4, d + " two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    empty = [(None, ""), (None, ""), (None, None), (3, " "), (3, " ")]
    full = [r for r in got if r not in empty]
    assert len(got) - len(full) == len(empty)
    assert len(full) == 4 and {r for r in full[:2]} == {(1, a), (1, b)}
    assert sum(r in [(None, c), (None, c + " near")] for r in full) == 1
    assert sum(r in [(4, d + " one"), (4, d + " two")] for r in full) == 1


@pytest.mark.parametrize("seed", range(5))
def test_low_tokens_rule_out_no_link(seed):
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        base = r.integers(0, 2**64, r.integers(1, 120), dtype=np.uint64)
        for keep in (1.0, 0.95, 0.9, 0.7):
            sets.append(np.unique(np.concatenate([base[r.random(len(base)) < keep], base[:1], r.integers(0, 2**64, r.integers(0, 6), dtype=np.uint64)])))
    n = np.array([len(s) for s in sets])
    # cut to few bits, so that many tokens are equal when cut
    low = [(s[s < np.uint64(2**63)] >> np.uint64(52)).astype(np.int64) for s in sets]
    for side in (np.zeros(len(sets), dtype=int), np.arange(len(sets)) % 2):
        got = ngram_join.hopeful(n, low, side, [np.arange(len(sets))], 90, 100)
        for i, u in enumerate(sets):
            for j, v in enumerate(sets):
                if i != j and (not side.any() or side[i] != side[j]):
                    common = len(np.intersect1d(u, v))
                    if common * 100 >= 90 * (len(u) + len(v) - common):
                        assert got[i] and got[j]
    assert not got.all()


def test_matches_sql(spark):
    got, want = H.same(ngram_join.op8_ngram_join(spark, H.D), H.duck().sql(ngram_join.ORACLE))
    assert got == want and any(r[0] != r[2] for r in want)


def test_very_long_text(spark):
    long = H.words(200_000, 1, 10**6)
    assert got(spark, [long, long + " x", "own words only", None]) == {0: (199_998, 0), 1: (199_999, 0), 2: (1, 2), 3: (0, 3)}
