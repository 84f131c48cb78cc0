import hashlib

import helpers as H
import pytest
from pyspark.sql import functions as F

from fedseek.llm import fingerprint as fp

HARD = ["", None, "one", "a b c d", "a b c d e", "é ü 日本語 text", "x" * 5000, "same " * 40, H.words(300), H.words(300), "😀 b " * 30, " \n\t "]


def grams(spark, texts):
    df = fp.with_prints(H.frame(spark, texts), "text", "p").orderBy("doc_id")
    return [[(x >> fp.LOW, fp.MASK - (x & fp.MASK)) for x in r.p] for r in df.collect()]


def test_windows_choose_the_rightmost_least(spark, monkeypatch):
    got = grams(spark, HARD)
    monkeypatch.setattr(fp, "W", 1)
    every = grams(spark, HARD)
    for mine, all_ in zip(got, every, strict=True):
        want = []
        for i in range(max(1, len(all_) - 3) if all_ else 0):
            best = min(all_[i : i + 4], key=lambda x: (x[0], -x[1]))
            if best not in want:
                want.append(best)
        assert mine == want


def test_shared_passage_has_a_common_fingerprint(spark):
    passage = H.words(fp.K + fp.W - 1, seed=9)
    a, b = grams(spark, [H.words(50, 1) + " " + passage + " " + H.words(30, 2), passage + " " + H.words(80, 3)])
    assert {h for h, _ in a} & {h for h, _ in b}


@pytest.mark.parametrize("step", [1, 97, -300])
def test_edited_texts(spark, step):
    docs = H.frame(spark, HARD).withColumn("doc_id", F.col("doc_id") * step).withColumn("block", F.lit(1))
    got = {r.doc_id: r for r in fp.edited_pairs(docs).collect()}
    rows = sorted(((i * step, x or "") for i, x in enumerate(HARD)), reverse=True)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if text == other:
            assert got[i].near_next == 1
    assert got[8 * step].fingerprint == got[9 * step].fingerprint != ""


def test_null_ids_repeats_one_and_none(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "x y"), (1, "x y"), (1, "z")], "doc_id long, text string")
    assert fp.edited_pairs(df).count() == 4
    assert fp.edited_pairs(df.where("text = 'z'")).first().near_next == 1
    assert fp.edited_pairs(df.limit(0)).count() == 0


def test_likeness_is_that_of_the_fingerprints(spark):
    """near_edited and near_next by plain sets of the hashes that the fingerprints show."""
    rows = sorted(fp.op1_fingerprints(spark, H.D).collect(), key=lambda r: -r.doc_id)
    own = lambda x: {p.split(":")[0] for p in x.split()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        assert abs(r.near_edited - like(own(r.fingerprint), own(r.edited_fingerprint))) < 1e-12
        assert abs(r.near_next - like(own(r.fingerprint), own(after.fingerprint))) < 1e-12
    assert any(0 < r.near_edited < 1 for r in rows)


def test_grams_of_equal_tokens_are_equal_and_others_differ(spark, monkeypatch):
    """Of all grams of many texts: one hash for each run of K lower-case tokens, whatever stands around it, and no two of them alike."""
    monkeypatch.setattr(fp, "W", 1)
    texts = [H.words(80, i % 6, 12) + " Tail é " + str(i) for i in range(12)]
    by_gram, by_hash = {}, {}
    for text, found in zip(texts, grams(spark, texts), strict=True):
        words = text.lower().split()
        assert [p for _, p in found] == list(range(len(words) - fp.K + 1))
        for h, p in found:
            gram = tuple(words[p : p + fp.K])
            assert by_gram.setdefault(gram, h) == h
            assert by_hash.setdefault(h, gram) == gram
    assert len(by_gram) > 300
