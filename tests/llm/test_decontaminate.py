import random

import helpers as H

from fedseek.llm import decontaminate as dc


def distance(pattern, text):
    """Least edits of pattern over all stretches of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        last, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return min(row)


def edited(r, text, n):
    x = list(text)
    for _ in range(n):
        at = r.randrange(len(x))
        kind = r.randrange(3)
        if kind == 0:
            x[at] = "q"
        elif kind == 1:
            x.insert(at, "q")
        else:
            del x[at]
    return "".join(x)


def test_bit_parallel_distance():
    r = random.Random(3)
    for _ in range(150):
        p = "".join(r.choice("abc") for _ in range(r.randrange(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randrange(0, 40))) + edited(r, p, r.randrange(5)) + "abba"
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        want, errors = distance(p, t), len(p)
        assert dc.best_match(masks, len(p), t, errors)[0] == want
        assert (dc.best_match(masks, len(p), t, want - 1) is None) == (want >= 0)


def test_pieces_cover():
    for n in (40, 41, 99):
        assert "".join(p for _, p in dc.pieces("x" * n, 3)) == "x" * n and len(dc.pieces("x" * n, 3)) == 4


def pairs(spark, texts, items, **how):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.distance for r in dc.contaminated(H.frame(spark, texts), bench, **how).collect()}


def test_against_all_pairs(spark):
    r = random.Random(5)
    items = [(i, H.words(r.randrange(8, 30), 100 + i)) for i in range(8)] + [(90, None), (91, "short"), (92, ""), (93, H.words(20, 100))]
    texts = [None, "", "  "]
    for i in range(40):
        text = items[i % 8][1]
        texts.append(f"{H.words(20, i)} {edited(r, text, r.randrange(0, 2 + len(text) // 14))}\n {H.words(9, -i)}".upper())
    want = {}
    for i, x in enumerate(texts):
        for k, y in items:
            y = dc.normal(y)
            if len(y) >= dc.SHORTEST and x and (d := distance(y, dc.normal(x))) <= int(len(y) * dc.RATE):
                want[i, k] = d
    assert want and pairs(spark, texts, items) == want
    assert pairs(spark, texts, items, block_chars=200) == want
    assert pairs(spark, texts, [(1, None)]) == {}
    docs = H.frame(spark, texts).withColumnRenamed("lang", "leak_h")
    left = dc.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns
    assert {x.doc_id for x in left.collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_whole_table(spark):
    docs = [(r.doc_id, dc.normal(r.text)) for r in spark.read.parquet(f"{H.D}/documents.parquet").collect()]
    items = [(r.item_id, dc.normal(r.text)) for r in spark.read.parquet(f"{H.D}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in dc.op6_decontaminate(spark, H.D).collect()}
    assert {(i, k) for i, x in docs for k, y in items if len(y) >= dc.SHORTEST and y in x} <= got


def test_short_items_are_whole_words(spark):
    texts = ["to be or not to be", "to be or not to bee", "TO  BE or\nnot to be.", "x东京是日本的首都y", "x东京", None, "to be or not to b", "2+2=4", "12+2=4"]
    items = [(1, "To be or not to be"), (2, "东京是日本的首都"), (3, "2+2=4"), (4, ""), (5, None)]
    want = {(0, 1): 0, (2, 1): 0, (3, 2): 0, (7, 3): 0}
    assert pairs(spark, texts, items) == want
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, texts[0], 1), (None, texts[0], 2), (None, "clean", 3), (7, texts[0], 4), (7, "clean", 5), (8, "w " * 400_000 + texts[7], 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leak_doc long")
    assert sorted(r.leak_doc for r in dc.clean(docs, bench).collect()) == [3, 5]
    assert dc.contaminated(docs, bench).count() == 4 and dc.contaminated(docs.limit(0), bench).count() == 0
