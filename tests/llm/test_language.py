import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import helpers as H
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fedseek.llm import language


def test_held_out_accuracy_and_scores(spark):
    d = H.D.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = language.op10_language(spark, d).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in own) / len(own) > 0.95
    assert sum(r.rejected for r in rows) / len(rows) < 0.05


def test_mass_of_the_model_is_one():
    import pandas as pd

    texts = {"a": "abababac abacaba " * 9, "b": "bcbcbd dcbcb " * 9}
    rows = [(k, x[i : i + 4]) for k, v in texts.items() for x in [" " * 3 + v] for i in range(len(x) - 3)]
    counts = pd.DataFrame(rows, columns=["lang", "gram"]).groupby(["lang", "gram"]).size().rename("n").reset_index()
    m = language._kneser_ney(["a", "b"], counts)
    import numpy as np

    for k, v in enumerate(texts.values()):
        for context in ("   ", "aba", "zzz", "bcb"):  # what the language has seen, and one character that it has not
            c = np.array([[ord(x) for x in context + y] for y in [*sorted(set(v)), "Q"]], dtype=np.uint32)
            assert abs(m.probability(c)[:, k].sum() - 1) < 1e-6


def test_edges(spark):
    texts = [None, "", "123 !?", "日本語", "the quick fox", "x" * 3_000_000] + ["the house and the garden of the man"] * 30
    docs = H.frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") > 5, F.col("lang"))).withColumnRenamed("n_chars", "lang_judged")
    out = {r.doc_id: r for r in language.identified(docs).collect()}
    assert [out[i].lang_pred for i in range(3)] == ["und"] * 3 and out[4].lang_pred == "en"
    assert len(out) == len(texts)
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and set(range(6, 36)) <= {r.doc_id for r in kept.collect()}
    assert not {0, 1, 2, 3} & {r.doc_id for r in kept.collect()}
    assert language.identified(docs.limit(0)).count() == 0


def plain_kneser_ney(text):
    """P(character | context) by dictionaries, interpolated down to single characters."""
    padded = "   " + text + " "
    level = Counter(padded[i : i + 4] for i in range(len(padded) - 3))
    levels = []
    for n in (4, 3, 2, 1):
        once, twice = (sum(v == k for v in level.values()) for k in (1, 2))
        d = min(max(once / (once + 2 * twice) if once + 2 * twice else 0.5, 0.1), 0.9)
        total, kinds = defaultdict(int), defaultdict(int)
        for g, v in level.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        levels.append((n, dict(level), d, total, kinds))
        level = Counter(g[1:] for g in level)

    def p(gram):
        out = 0.0
        for n, c, d, total, kinds in reversed(levels):
            g = gram[4 - n :]
            if n == 1:
                out = (c[g] - d if g in c else 0.0) / total[""] + d * kinds[""] / total[""] / (kinds[""] + 1) + 1e-9
            elif g[:-1] in total:
                out = (c[g] - d if g in c else 0.0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * out
        return out

    return p


def test_entropy_score_and_rejection_by_plain_sums():
    texts = {"a": "abababac abacaba " * 9 + "the end", "b": "bcbcbd dcbcb " * 9}
    rows = [(k, x[i : i + 4]) for k, v in texts.items() for x in ["   " + v + " "] for i in range(len(x) - 3)]
    counts = pd.DataFrame(rows, columns=["lang", "gram"]).groupby(["lang", "gram"]).size().rename("n").reset_index()
    m = language._kneser_ney(["a", "b"], counts)
    m.sharp, m.worst = 0.7, np.array([1.5, 2.0])
    tries = ["abab", "bcbd", "zq", "a", "dcb aba", "", "the bad end " * 30]
    models = [plain_kneser_ney(texts[k]) for k in "ab"]
    want = [[-sum(math.log(p(("   " + t + " ")[i : i + 4])) for i in range(len(t) + 1)) / (len(t) + 1) for p in models] for t in tries]
    ce, n = m.entropy(tries)
    pred, score, rejected = m.judge(tries)
    for i, t in enumerate(tries):
        if not t:
            assert (pred[i], score[i], rejected[i]) == ("und", 0.0, True)
            continue
        assert ce[i] == pytest.approx(want[i], rel=1e-4) and n[i] == len(t) + 1
        best = int(np.argmin(want[i]))
        s = 1 / sum(math.exp((want[i][best] - w) * 0.7 * math.sqrt(min(len(t) + 1, 400))) for w in want[i])
        assert pred[i] == "ab"[best] and score[i] == pytest.approx(s, rel=1e-2)
        assert rejected[i] == (want[i][best] > m.worst[best] + language.SLACK / math.sqrt(len(t) + 1))


def test_letters_marks_ties_and_small_languages(spark):
    assert language.letters("½ ② Ⅷ ² 7_") == "" and language.letters("\u0301") == ""
    assert language.letters("हिन्दी, ÉTÉ") == "हिन्दी été"
    texts = ["½", "② Ⅷ"] + ["हिन्दी में एक वाक्य"] + ["the house of the man"] * 12 + ["same words here"] * 2
    rows = [(i, x, "hi" if i == 2 else "en" if i < 15 else "xy"[i - 15]) for i, x in enumerate(texts)]
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(learn[i], x, y) for i, x, y in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identified(docs).collect()}
    assert [got[learn[i]] for i in (0, 1, 2, 3)] == ["und", "und", "hi", "en"]  # one document is enough to be learned
    assert got[learn[15]] == got[learn[16]] == "x"  # x and y have equal models: the first by name
    twice = language.identified(docs.union(docs)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("lang_pred", "score").alias("k"))
    assert twice.where("n != 2 or k != 1").count() == 0
    assert {r.lang_pred for r in language.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_a_large_batch_is_cut_and_judged_in_runs():
    texts = [H.words(300, i) for i in range(1000)] + [None, "", "1 2", "x" * 300_000] + ["the house of the man"] * 5
    batch = pa.record_batch({"lang": [f"l{i % 2}" for i in range(len(texts))], "text": texts})
    want = Counter()
    for i, x in enumerate(texts):
        x = "   " + language.letters(x) + " "
        want.update((f"l{i % 2}", x[k : k + 4]) for k in range(len(x) - 3) if len(x) > 4)
    got = Counter()
    for r in pa.Table.from_batches(language._counted(iter([batch]))).to_pylist():
        got[r["lang"], r["gram"]] += r["n"]
    assert got == want
    counts = pd.DataFrame([(*k, n) for k, n in sorted(want.items())], columns=["lang", "gram", "n"])
    m = language._kneser_ney(["l0", "l1"], counts)
    m.worst = np.array([9.0, 9.0])
    whole = m.judge([language.letters(x) for x in texts])
    tracemalloc.start()
    parts = m.judge_all(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts[0] == whole[0] and all((a == b).all() for a, b in zip(parts[1:], whole[1:], strict=True))
    assert peak < 30e6  # 45 MB all at once
