import re

import helpers as H
import pytest

from fedseek.llm import mixing


def want_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()) * share, set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= sizes[s] * most}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = sizes[s] * most
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, None: 30}, {"a": 1, "b": 1000, "c": 5, "d": 5}, {"a": 7}, {"B": 5, "a": 900, "é": 3, "\U0001F600": 4, "￿": 8}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(want_targets(sizes))


def test_whole_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{H.D}/documents.parquet").collect()}
    rows = mixing.op7_mixing(spark, H.D).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or ""))
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        s = docs[r.doc_id].source
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
    want = want_targets(sizes)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(r.size for r in rows if docs[r.doc_id].source == s) / 2 + 1e-6
    assert rows and sorted(mixing.op7_mixing(spark, H.D).collect()) == sorted(rows)


def test_many_units_reach_their_target(spark):
    texts = ["w " * (1 + i % 7) for i in range(3000)]
    docs = H.frame(spark, texts, source=["hot" if i % 3 else f"s{i % 5}" for i in range(3000)])
    m = mixing.mixed(docs).groupBy("source", "target").agg({"size": "sum"}).count()
    out = mixing.mixed(docs).selectExpr("source", "target", "copies * size as t").groupBy("source", "target").sum("t").collect()
    assert m == 6 and all(abs(r[2] - r[1]) <= 4 for r in out)
    copied = mixing.mix(docs)
    assert copied.columns == [*docs.columns, "copy_no"]
    assert copied.selectExpr("sum(size(split(trim(text), ' ')))").first()[0] == sum(r[2] for r in out)


def test_chances_are_kept(spark):
    docs = H.frame(spark, ["w " * 5 for _ in range(150)], source=["abc"[i % 3] for i in range(150)])
    runs = [{r.k: r.copies for r in mixing.mixed(docs, seed=seed).collect()} for seed in range(3)]
    c = [sum(r[k] for r in runs) for k in range(2, 150, 3)]  # 5/3 copies each in the mean
    assert 1.5 < sum(c) / len(c) / 3 < 1.8 and len(set(c)) > 1


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (None, "one", "a"), (None, "one", "a"), (4, "x " * 50, "a"), (4, "x " * 50, "a"), (5, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mixed(docs).where("size = 0 and copies > 0").count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs).agg({"rows": "sum"}).first()[0] == len(rows)


def test_long_texts_and_clashing_names(spark):
    docs = H.frame(spark, ["w " * 300_000, *["a b c"] * 40], source=["s" if i % 2 else "t" for i in range(41)]).withColumnsRenamed({"lang": "copy_no", "n_chars": "MIX_H"})
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "_copy_no"] and out.count() > 0
