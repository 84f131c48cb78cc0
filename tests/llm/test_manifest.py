import zlib
from hashlib import sha256

import pytest
from helpers import DOCS, D, duck, same
from pyspark.sql import functions as F

from fedseek.llm.manifest import ORACLE, manifest, op13_manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def up(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i - i % 3
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 3])))
        i //= 3
    return out


def plainly(rows, odd=False):
    """The contract in plain Python, over rows (doc_id, text, lang, source, n_chars)."""
    own = {}
    for r in rows:
        own.setdefault(r[3], []).append(r)
    names = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        own[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = [climb([leaf(*r) for r in own[s]]) for s in names]
    top = climb([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for j, s in enumerate(names):
        for i, r in enumerate(own[s]):
            path = up(trees[j], i) + up(top, j)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            x = leaf(r[0], r[1] and r[1].replace("\n", ""), *r[2:]) if bad else leaf(*r)
            for a, b in path:
                x = h(a, x, b)
            out.append((r[0], leaf(*r), trees[j][-1][0], root, h(*(y for p in path for y in p)), x, x == root))
    return sorted(out, key=repr)


def ours(spark, data, **how):
    docs = spark.createDataFrame(data, DOCS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return sorted((tuple(r) for r in manifest(docs, even, {"text": F.replace("text", F.lit("\n"), F.lit(""))}, **how).collect()), key=repr)


def many(n, sources):
    return [(i * 7 % 1000, f"text {i}\nnext é", "en", sources[i % len(sources)], i) for i in range(n)]


def test_matches_sql_at_small_scale(spark):
    got, want = same(op13_manifest(spark, D), duck().sql(ORACLE))
    assert got == want
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (3, ["a"]), (4, ["a"]), (28, ["a"]), (40, [None, "a", "b", "ä", "", "a", "a"]), (13, list("abcdefghijklm"))])
def test_shapes_of_trees_over_many_partitions(spark, n, sources):
    """Partitions of a few leaves, merged two at a time, so that runs of every level are cut."""
    rows = many(n, sources)
    want = plainly(rows)
    assert ours(spark, rows, rows=4, fan=2) == want
    assert ours(spark, rows, rows=1, fan=3) == want


def test_hot_source_and_repeated_rows(spark):
    """One source with most rows, a row that stands 30 times, ids that repeat with other texts, nulls in every column, an empty and a long text."""
    rows = many(60, ["hot"]) + [(5, "same", "en", "hot", 4)] * 30 + [(5, "other\n", "en", "hot", 6), (5, None, None, "cold", None), (None, "x\ny", "en", "hot", 3), (None, None, None, None, None)]
    rows += [(7, "", "en", "cold", 0), (8, "line\n" * 200_000, "en", "cold", 1_000_000)]
    want = plainly(rows)
    assert ours(spark, rows, rows=9, fan=3) == want
    assert ours(spark, rows) == want


def test_null_and_empty_differ_and_other_columns_do_not_matter(spark):
    a = ours(spark, [(1, None, "en", "s", 0)])[0]
    assert a[1] != ours(spark, [(1, "", "en", "s", 0)])[0][1]
    assert a[1] == a[2] == a[3] and a[4] == h()
    docs = spark.createDataFrame([(1, None, "en", "s", 0, "x", 3, 4)], DOCS + ", leaf string, block long, pos long")
    assert manifest(docs, F.lit(False), {}).first().leaf == a[1]


def test_empty_table(spark):
    assert ours(spark, []) == []


def test_only_rows_that_change_fail(spark):
    rows = many(50, ["a", "b"])
    got = {r[0]: r for r in ours(spark, rows, rows=10)}
    for i, *_ in rows:
        assert got[i][-1] == (zlib.crc32(str(i).encode()) % 2 != 0)
