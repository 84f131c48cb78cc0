import helpers as H

import corpus_pipeline as cp
from fedseek.llm import decontaminate, language, lines, ngram_join


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{H.D}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, H.D).cache()
        ids = {r.doc_id for r in docs.collect()}
        assert ids and ids <= {r.doc_id for r in before.collect()}, name
        if name != "mix":
            assert docs.columns == columns and docs.count() == len(ids)
        if name == "language":
            want = {r.doc_id for r in language.identified(before).where("not rejected").collect()}
            assert ids == want
        if name == "near_duplicates":
            import test_ngram_join as T

            own = T.brute([(r.doc_id, r.text) for r in before.collect()], k=5, num=80)
            assert ids == {i for i, (_, c) in own.items() if c == i}
        if name == "leaks":
            items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{H.D}/benchmark.parquet").collect()]
            assert not any(y in decontaminate.normal(r.text) for r in docs.collect() for y in items)
    assert set(docs.columns) == {*columns, "copy_no"}


def test_lines_go_and_characters_follow(spark):
    docs = spark.read.parquet(f"{H.D}/documents.parquet")
    out = cp.drop_boilerplate(spark, docs, H.D).where("length(text) != n_chars").count()
    assert out == docs.where("length(text) != n_chars").count()
    assert lines.SITES > 1 and ngram_join.K == 3


def test_hard_rows_pass_every_stage(spark):
    texts = [None, "", " ", "12345", "x" * 200_000, "the same text of a few words\n" * 5, "the same text of a few words\n" * 5, *(H.words(60, i) for i in range(20))]
    start = H.frame(spark, texts, source=[None if i % 5 == 0 else f"s{i % 3}" for i in range(len(texts))])
    for docs in (start, start.limit(0), start.withColumn("doc_id", H_null())):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, H.D)
        docs.count()


def H_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("long")


def test_clashing_names_ties_and_repeated_rows_pass_every_stage(spark):
    """Columns named as the stages name their own come through with their values; rows that repeat a document share its fate."""
    names = ["n", "k", "h", "node", "token", "row_key", "size", "key", "line", "n_lines_removed", "rejected", "score", "leak_h", "block", "pos", "word", "u", "v", "component", "gone", "rows", "target", "taken", "lang_pred"]
    texts = [f"the same line of boiler\n{H.words(60, i)}" for i in range(20)] * 2 + [H.words(50, 1)] * 3
    docs = H.frame(spark, texts, source=[f"s{i % 12}" for i in range(len(texts))])
    from pyspark.sql import functions as F

    docs = docs.withColumn("doc_id", F.col("doc_id") % 25).withColumns({c: F.col("doc_id") + 1000 + i for i, c in enumerate(names)})
    columns = docs.columns
    for name, stage in cp.STAGES:
        before, docs = {r.doc_id for r in docs.collect()}, stage(spark, docs, H.D)
        rows = docs.collect()
        assert rows and {r.doc_id for r in rows} <= before, name
        assert docs.columns[: len(columns)] == columns, name
        assert all(r[c] == r.doc_id + 1000 + i for r in rows for i, c in enumerate(names)), name
