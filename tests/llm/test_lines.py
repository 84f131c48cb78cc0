import helpers as H

from fedseek.llm import lines


def test_matches_sql(spark):
    got, want = H.same(lines.op2_line_dedup(spark, H.D), H.duck().sql(lines.ORACLE))
    assert got == want and any(r[2] for r in want)


def test_threshold_is_exact_and_first_stays(spark):
    texts = [f"own {i}\n common \nrare" if i < 9 else f"own {i}\ncommon" for i in range(10)] + [None, "", "\n\n", "common\ncommon"]
    docs = H.frame(spark, texts, source=[f"s{i % 10}" for i in range(len(texts))])
    out = {r.doc_id: r.text for r in lines.deduplicated(docs.withColumnsRenamed({"n_chars": "line_gone"}), sites=10).collect()}
    assert out[0] == texts[0]
    assert all(out[i] == f"own {i}\nrare" for i in range(1, 9)) and out[9] == "own 9"
    assert (out[10], out[11], out[12], out[13]) == (None, "", "\n\n", "")


def test_many_sites_go_by_sketch(spark):
    texts = [f"own {i}\neverywhere" for i in range(400)]
    docs = H.frame(spark, texts, source=[f"s{i % 200}" for i in range(400)])
    row = lines.spread(docs).collect()
    assert len(row) == 1 and not row[0].exact and abs(row[0].sites - 200) < 50
    assert lines.deduplicated(docs).where("n_lines_removed = 1").count() == 399


def test_repeats_null_ids_null_sources_none(spark):
    rows = [(None, "x", None)] * 3 + [(1, "x", "a"), (1, "x", "a")] + [(i, "x", f"s{i}") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = lines.deduplicated(docs)
    assert out.count() == len(rows) and [r.doc_id for r in out.where("text = 'x'").collect()] == [1, 1]
    assert lines.deduplicated(docs.limit(0)).count() == 0


def test_a_null_source_is_one_more_site(spark):
    for named, goes in ((8, False), (9, True)):
        sources = [f"s{i}" for i in range(named)] + [None, None]
        docs = H.frame(spark, [f"own {i}\ncommon" for i in range(len(sources))], source=sources)
        removed = {r.doc_id: r.n_lines_removed for r in lines.deduplicated(docs).collect()}
        assert removed == {i: int(goes and i > 0) for i in range(len(sources))}


def test_very_long_text_and_clashing_names(spark):
    texts = ["own\n" * 50_000 + "common", *[f"x{i}\ncommon" for i in range(12)], "y" * 1_000_000]
    docs = H.frame(spark, texts, source=[f"s{i}" for i in range(len(texts))]).withColumnsRenamed({"lang": "line_h", "n_chars": "Line_Doc"})
    out = {r.doc_id: r for r in lines.deduplicated(docs).collect()}
    assert out[0].text == texts[0] and out[13].text == texts[13] and all(out[i].text == f"x{i - 1}" for i in range(1, 13))
