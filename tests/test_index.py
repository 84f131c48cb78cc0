"""The index and search expressions against plain Python, on rows that the tables can't offer."""

import math
import re
from collections import Counter, defaultdict

import pytest

from fedseek.operators import expressions as E
from fedseek.operators import index as I

DOCS = "doc_id long, text string, source string"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


HARD = [
    (1, "The cat sat on the mat; the cat!", "a"),
    (2, "the the the THE the", "a"),
    (3, "Über Straße x2 über_all 4K über", None),
    (4, None, "b"),
    (5, "", "b"),
    (6, "-- ... --", "b"),
    (7, "cat the sat", "a"),
    (7, "cat the sat", "a"),
    (7, "another text of the same id", "b"),
    (None, "the cat without an id", "a"),
    (8, "the " * 50_000 + "end", "hot"),
    (9, "cat", "a"),
]
HARD += [(100 + i, f"common term{i % 7} of the hot source and w{i}", "hot") for i in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in HARD], DOCS + ", term long, block long, bucket string, n long").repartition(5)


@pytest.fixture(scope="module")
def index(docs):
    # terms in over 40 documents are dealt over blocks, and few postings make a bucket; tasks as small as these would be put together
    spark, name = docs.sparkSession, "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield I.scratch_index(docs, "source", bucket_rows=100, hot=40)
    spark.conf.unset(name)


def distinct():
    return sorted({(i, t, s) for i, t, s in HARD if i is not None}, key=repr)


def test_postings(index):
    want = set()
    for i, t, _ in distinct():
        at = defaultdict(list)
        for p, w in enumerate(words(t)):
            at[w].append(p)
        want |= {(w, i, len(words(t)), len(p), tuple(p)) for w, p in at.items()}
    got = [(r.term, r.doc_id, r.n, r.tf, tuple(r.positions)) for r in index.postings.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert index.n_documents == len(distinct()) and index.n_words == sum(len(words(t)) for _, t, _ in distinct())
    df = Counter(w for w, *_ in want)
    assert {r.term: r.df for r in index.terms.collect()} == df


def test_a_hot_term_is_in_several_files(index):
    from pyspark.sql import functions as F

    files = index.postings.where("term = 'common'").select(F.input_file_name().alias("f"), "doc_id").groupBy("f").count().collect()
    assert len(files) > 3 and max(r["count"] for r in files) < 150
    assert index.postings.where("term = 'cat'").select(F.input_file_name()).distinct().count() == 1


def test_a_task_writes_as_many_postings_however_large_the_table(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(I, "TASK", 250, raising=False)
    for n in (200, 800):
        docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j * j) % 700}" for j in range(12)) + " every", "a") for i in range(n)], DOCS)
        built = I.scratch_index(docs, "source", hot=60)
        task = F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1).alias("task")
        rows = {r.task: r["count"] for r in built.postings.groupBy(task).count().collect()}
        assert sum(rows.values()) == built.terms.agg(F.sum("df")).first()[0] > n * 8
        assert max(rows.values()) < 2.5 * 250
        assert built.of(["every"]).count() == n


def bm25(terms, k1=1.2, b=0.75):
    rows = distinct()
    tf = [Counter(words(t)) for _, t, _ in rows]
    n = [sum(c.values()) for c in tf]
    out = []
    for (i, t, _), c, length in zip(rows, tf, n, strict=True):
        score = 0
        for q in set(terms):
            df = sum(q in x for x in tf)
            if c[q]:
                idf = math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * terms.count(q)
                score += round(idf * c[q] * (k1 + 1) / (c[q] + k1 * (1 - b + b * length / (sum(n) / len(rows)))) * 1e6)
        if any(c[q] for q in terms):
            out.append((i, score))
    return sorted(out)


@pytest.mark.parametrize("terms", [["the"], ["cat", "the", "cat"], ["common", "w7", "absent"], ["absent"], ["über"]])
def test_scores(index, terms):
    got, want = sorted((r.doc_id, r.score) for r in I.ranked(index, terms).collect()), bm25(terms)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) <= 2 for (_, a), (_, b) in zip(got, want, strict=True))


def test_best_settles_ties_by_id(index):
    got = [(r.rank, r.doc_id) for r in I.best(index, ["common"], 5).orderBy("rank").collect()]
    score = dict(bm25(["common"]))
    assert got == list(enumerate(sorted(score, key=lambda i: (-score[i], i))[:5], 1))
    assert I.best(index, ["absent"], 5).collect() == []


@pytest.mark.parametrize("text", ["the cat", "the the", "the the the", "cat the sat", "of the hot source", "mat the", "hot the", "sat"])
def test_phrases_overlap(index, text):
    q = words(text)
    want = []
    for i, t, _ in distinct():
        w = words(t)
        n = sum(w[p : p + len(q)] == q for p in range(len(w)))
        want += [(i, n)] if n else []
    assert sorted((r.doc_id, r.tf) for r in I.phrase(index, q).collect()) == sorted(want)


def test_no_text_is_read_and_folders_are_left_out(index, docs):
    for df in (I.best(index, ["cat"], 3), I.phrase(index, ["the", "cat"]), E.found(index, ~E.Word("cat") & E.Field("source", "a"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "text" not in plan
    assert "PartitionFilters: [bucket" in I.phrase(index, ["cat"])._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket#", "[bucket").replace("[[", "[")


SEARCHES = {
    "and": E.Word("cat") & E.Word("the"),
    "or before not": E.Word("MAT") | ~E.Word("the"),
    "and binds": E.Word("mat") | E.Word("cat") & E.Word("sat"),
    "brackets": (E.Word("mat") | E.Word("cat")) & E.Word("sat"),
    "phrase": E.Phrase("The, cat") & ~E.Phrase("cat the"),
    "twice": E.Phrase("the the the"),
    "prefix": E.Prefix("über") | E.Prefix("w1"),
    "field": E.Field("source", "hot") & ~E.Word("common"),
    "field or": E.Field("source", "b") | E.Word("4k"),
    "only not": ~E.Any((E.Word("the"), E.Word("common"), E.Prefix("c"))),
    "not not": ~~E.Word("straße"),
    "all": E.All((E.Word("cat"), ~E.Field("source", "a"))),
    "whole words": E.Word("k"),
}


def holds(x, text, source):
    w = words(text)
    if isinstance(x, E.All):
        return all(holds(p, text, source) for p in x.parts)
    if isinstance(x, E.Any):
        return any(holds(p, text, source) for p in x.parts)
    if isinstance(x, E.Not):
        return not holds(x.part, text, source)
    if isinstance(x, E.Field):
        return source == x.value
    if isinstance(x, E.Prefix):
        return any(y.startswith(x.text.lower()) for y in w)
    return any(w[p : p + len(x.words)] == x.words for p in range(len(w)))


@pytest.mark.parametrize("name", sorted(SEARCHES))
def test_expressions_on_texts_and_on_the_index(docs, index, name):
    x = SEARCHES[name]
    want = sorted((i is None, i or 0) for i, t, s in HARD if holds(x, t, s))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.where(E.condition(x)).collect()) == want
    want = sorted(i for i, t, s in distinct() if holds(x, t, s))
    assert sorted(r.doc_id for r in E.found(index, x).collect()) == want


def test_saved_searches_in_one_scan(docs):
    df = E.matches(docs, SEARCHES)
    got = Counter((r.search, r.doc_id) for r in df.collect())
    assert got == Counter((n, i) for n, x in SEARCHES.items() for i, t, s in HARD if holds(x, t, s))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1 or plan.count("Filter") == 0


@pytest.mark.parametrize(
    "make",
    [lambda: E.Word("two words"), lambda: E.Word(""), lambda: E.Phrase(" .. "), lambda: E.Prefix("a b"), lambda: E.Prefix(""), lambda: E.All(()), lambda: E.Field("source", None)],
)
def test_wrong_parts(make):
    with pytest.raises(ValueError):
        make()


def test_wrong_types():
    with pytest.raises(TypeError):
        E.Word("a") & "b"
    with pytest.raises(TypeError):
        bool(E.Word("a"))
    with pytest.raises(TypeError):
        E.Word("a") and E.Word("b")
    with pytest.raises(TypeError):
        E.Not("a")


def test_empty_table(docs):
    none = I.scratch_index(docs.limit(0), "source")
    assert none.n_documents == 0
    assert I.best(none, ["a"], 3).collect() == I.phrase(none, ["a", "b"]).collect() == E.found(none, ~E.Word("a")).collect() == []
    assert docs.limit(0).where(E.condition(~E.Word("a"))).collect() == []
