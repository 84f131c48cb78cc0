"""Words within two edits of a vocabulary's terms: typo-tolerant keywords (A2).

Two words within two edits become equal when at most two characters of each are
deleted, so words of up to SHORT characters meet by the hashes of what such
deletions leave. A longer term has three pieces, of which two edits leave one
whole, moved by two places at most; words meet it by the pieces they have near
those places. Meetings are an equi-join of hashes and `levenshtein` settles
them, so none is missed and no pair of words is compared that shares nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDITS, SHORT = 2, 16


def _one_less(word: Column) -> Column:
    """What is left of a word without one of its characters, each in turn."""
    n = F.length(word)
    left = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.when(n > 0, left).otherwise(F.array().cast("array<string>"))


def _deletions(word: Column) -> Column:
    one = _one_less(word)
    two = F.flatten(F.transform(one, _one_less))
    return F.transform(F.array_distinct(F.concat(F.array(word), one, two)), lambda x: F.xxhash64(F.lit(-1), x))


def _bounds(n: Column, i: int) -> tuple[Column, Column]:
    """First character and length of piece i of a word of n characters."""
    first = F.floor(n * i / (EDITS + 1))
    return first, F.floor(n * (i + 1) / (EDITS + 1)) - first


def _pieces(term: Column) -> Column:
    n = F.length(term)
    return F.array(*(F.xxhash64(n, F.lit(i), F.substring(term, first + 1, size)) for i in range(EDITS + 1) for first, size in (_bounds(n, i),)))


def _near_pieces(word: Column) -> Column:
    """Hashes of all that a long term within two edits may have as a piece."""
    m, out = F.length(word), []
    for d in range(-EDITS, EDITS + 1):
        n = m + d
        for i in range(EDITS + 1):
            first, size = _bounds(n, i)
            for by in range(-EDITS, EDITS + 1):
                at = first + by
                fits = (n > SHORT) & (at >= 0) & (at + size <= m)
                out.append(F.when(fits, F.xxhash64(n, F.lit(i), F.substring(word, at + 1, size))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def neighbours(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word, term, distance: each pair of a word of words (word) and a term of terms (term) within two edits, once.

    Equal ones have distance 0. Nulls have no neighbours; an empty word has the
    terms of up to two characters. Words count once however often they stand.
    An edit is a character put in, left out or replaced; case counts.
    """
    word, term = F.col("word"), F.col("term")
    none = F.array().cast("array<bigint>")
    asked = F.concat(F.when(F.length(word) <= SHORT + EDITS, _deletions(word)).otherwise(none), F.when(F.length(word) > SHORT - EDITS, _near_pieces(word)).otherwise(none))
    held = F.when(F.length(term) <= SHORT, _deletions(term)).otherwise(_pieces(term))
    left = words.where(word.isNotNull()).select("word").distinct().select("word", F.explode(asked).alias("key"))
    right = terms.where(term.isNotNull()).select("term").distinct().select("term", F.explode(held).alias("key"))
    met = left.join(right, "key").where(F.abs(F.length(word) - F.length(term)) <= EDITS).withColumn("distance", F.levenshtein(word, term, EDITS))
    return met.where(F.col("distance") >= 0).select("word", "term", "distance").distinct()
