"""Neighbours of words against all pairs."""

import random

import pytest

from fedseek.operators.typo import SHORT, neighbours


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(r, w, n, letters):
    w = list(w)
    for _ in range(n):
        k, at = r.randrange(3), r.randrange(len(w) + 1)
        if k == 0:
            w.insert(at, r.choice(letters))
        elif w:
            at = min(at, len(w) - 1)
            w[at : at + 1] = [] if k == 1 else [r.choice(letters)]
    return "".join(w)


def pairs(a, b):
    return sorted((x, y, d) for x in set(a) for y in set(b) if x is not None and y is not None and abs(len(x) - len(y)) <= 2 and (d := distance(x, y)) <= 2)


@pytest.mark.parametrize(("letters", "lengths"), [("ab", range(7)), ("abcdé中\U0001f600", range(3, SHORT + 2)), ("abc", range(SHORT - 3, SHORT + 6)), ("abcdefgh", range(20, 60))])
def test_all_pairs_within_two_edits(spark, letters, lengths):
    r = random.Random(len(letters))
    terms = ["".join(r.choice(letters) for _ in range(r.choice(lengths))) for _ in range(120)]
    terms += [edited(r, r.choice(terms), r.randrange(4), letters) for _ in range(80)]
    words = [edited(r, r.choice(terms), r.randrange(4), letters) for _ in range(80)] + terms[:20] * 2 + ["", None]
    got = neighbours(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t, "x", 1) for t in [*terms, None, "", terms[0]]], "term string, word string, key long"))
    want = pairs(words, [*terms, ""])
    assert sorted(tuple(x) for x in got.collect()) == want
    assert len(want) > 60


def test_joined_by_key_and_empty_tables(spark):
    words, terms = spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("a",)], "term string")
    plan = neighbours(words, terms)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert neighbours(words.limit(0), terms).collect() == neighbours(words, terms.limit(0)).collect() == []


def test_very_long_words(spark):
    long = "xyz" * 20_000
    got = neighbours(spark.createDataFrame([(long[:9] + long[10:],)], "word string"), spark.createDataFrame([(long,), (long[::-1],)], "term string"))
    assert [(len(x.term), x.distance) for x in got.collect()] == [(60_000, 1)]
