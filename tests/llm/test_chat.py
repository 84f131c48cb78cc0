import helpers as H
from pyspark.sql import functions as F

from fedseek.llm import chat

CONV = "conv_id long, turn long, role string, text string"


def test_matches_sql(spark):
    got, want = H.same(chat.op9_chat(spark, H.D), H.duck().sql(chat.ORACLE))
    assert got == want and any(r[0] == -1 for r in want)


def hard():
    marks = ["<|im_end|>", r"<\|im_start|>", r"<\\|x", "<|", "|>", "%0A %25\n", "", None, "ok\r\n", "$1 \\", "😀" * 9]
    rows = [(1, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(marks)]
    rows += [(2, 0, "system", "be brief")] + [(2, i, "assistant" if i % 2 else "user", H.words(40, i)) for i in range(1, 40)]
    rows += [(3, 0, "system", "alone"), (4, 0, "assistant", "long " * 2000), (4, 1, None, None), (None, 1, "assistant", "x"), (5, 0, "us\ner%", "q"), (5, 0, "us\ner%", "q"), (6, None, "assistant", "first"), (6, 0, "user", "then")]
    # over several segments; the system turn late in the first, and with turns of null number
    rows += [(7, 40, "system", "be kind")] + [(7, i, "assistant" if i % 2 else "user", H.words(9, i)) for i in range(41, 300)]
    rows += [(8, None, "system", "be kind"), (8, None, "user", "x"), (8, -70, "assistant", "y"), (8, 63, "user", "z"), (8, 64, "assistant", "z")]
    return rows


def test_round_trip(spark):
    rows = hard()
    back = {r.conv_id: r for r in chat.read_back(chat.windows(spark.createDataFrame(rows, CONV).withColumn("t", F.lit(1)))).collect()}
    import hashlib

    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        b = back[c]
        assert (b.n_turns, b.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (b.loss_chars, b.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_to_the_budget(spark):
    df = spark.createDataFrame([r for r in hard() if r[0] == 2], CONV)
    out = chat.windows(df).orderBy("segment", "window").collect()
    assert len(out) > 3
    for w in out:
        assert w.text.startswith("<|im_start|>system\nbe brief<|im_end|>\n")
        assert w.text.count("<|im_end|>\n") == w.text.count("<|im_start|>")
    assert all(w.repeated > 1 for w in out[1:])  # the system turn and some history
    n = chat.windows(df).select(F.regexp_count("text", F.lit(chat.TOKEN)).alias("n")).collect()
    assert max(r.n for r in n) <= chat.BUDGET


def test_budget_on_the_whole_table(spark):
    conv = spark.read.parquet(f"{H.D}/conversations.parquet").unionByName(spark.createDataFrame([r for r in hard() if r[0] != 4], CONV))
    n = chat.windows(conv).select(F.regexp_count("text", F.lit(chat.TOKEN)).alias("n")).collect()
    assert chat.BUDGET // 2 < max(r.n for r in n) <= chat.BUDGET


def test_only_the_order_of_turn_numbers_matters(spark):
    own = [r for r in hard() if r[0] == 7]
    read = lambda rows: [tuple(r)[1:] for r in chat.windows(spark.createDataFrame(rows, CONV)).orderBy("segment", "window").collect()]
    assert read(own) == read([(c, turn * 1000 - 77, role, text) for c, turn, role, text in own])
    # one number for all, or none: by role and text, in bounded segments
    for turn in (5, None):
        out = chat.windows(spark.createDataFrame([(1, turn, "user", H.words(5, i)) for i in range(200)], CONV)).collect()
        assert {w.segment for w in out} == {0, 1, 2, 3} and len(out) < 60


def test_segments_have_the_system_turn_and_history(spark):
    df = spark.createDataFrame([r for r in hard() if r[0] == 7], CONV)
    out = chat.windows(df).orderBy("segment", "window").collect()
    assert len({w.segment for w in out}) == 5
    for w in out:
        assert w.text.count("be kind") == 1 and w.text.startswith("<|im_start|>system\nbe kind")
    assert [w.repeated for w in out][0] == 0 and all(w.repeated > 1 for w in out[1:])


def test_none(spark):
    assert chat.windows(spark.createDataFrame([], CONV)).count() == 0
