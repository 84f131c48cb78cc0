"""Searches put together from words, phrases, prefixes and fields with &, | and ~ (A2, A6).

    (Word("night") | Phrase("day and night")) & ~Prefix("inter") & Field("source", "src3")

An expression is a tree of Python values and becomes one Column, which Catalyst
sees as a whole: `condition` for a table with texts, which it brings into
normal form once however many words it seeks; `found` for an index, which reads
no text. Python's operators give precedence: ~ before & before |. Words are
compared as in the index: in lower case, bounded by what is no letter, digit or
_. Null texts have no words, so only what is negated matches them; a null field
equals nothing. There is no query string: what users type is for the caller to
take apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedseek.operators.index import SEPARATOR, Index, starts


def _terms(text: str) -> list[str]:
    return [w for w in re.findall(r"\w+", text.lower())]


class Expression:
    """A search. Subclasses give `build`, from a function that says what becomes of a leaf."""

    def __and__(self, other: Expression) -> Expression:
        return All((self, _checked(other)))

    def __or__(self, other: Expression) -> Expression:
        return Any((self, _checked(other)))

    def __invert__(self) -> Expression:
        return Not(self)

    def __bool__(self) -> bool:
        raise TypeError("use &, | and ~ in place of and, or and not")

    def build(self, leaf: Callable[[Expression], Column]) -> Column:
        return leaf(self)

    def leaves(self) -> Iterator[Expression]:
        yield self


def _checked(x: object) -> Expression:
    if not isinstance(x, Expression):
        raise TypeError(f"not an expression: {x!r}")
    return x


@dataclass(frozen=True)
class _Several(Expression):
    parts: tuple[Expression, ...]

    def __post_init__(self) -> None:
        if not self.parts:
            raise ValueError("no parts")
        for x in self.parts:
            _checked(x)

    def leaves(self) -> Iterator[Expression]:
        for x in self.parts:
            yield from x.leaves()


class All(_Several):
    def build(self, leaf: Callable[[Expression], Column]) -> Column:
        return reduce(lambda a, b: a & b, (x.build(leaf) for x in self.parts))


class Any(_Several):
    def build(self, leaf: Callable[[Expression], Column]) -> Column:
        return reduce(lambda a, b: a | b, (x.build(leaf) for x in self.parts))


@dataclass(frozen=True)
class Not(Expression):
    part: Expression

    def __post_init__(self) -> None:
        _checked(self.part)

    def build(self, leaf: Callable[[Expression], Column]) -> Column:
        return ~self.part.build(leaf)

    def leaves(self) -> Iterator[Expression]:
        yield from self.part.leaves()


@dataclass(frozen=True)
class Phrase(Expression):
    """Words one after the other, whatever stands between them."""

    text: str

    def __post_init__(self) -> None:
        if not _terms(self.text):
            raise ValueError(f"no word in {self.text!r}")

    @property
    def words(self) -> list[str]:
        return _terms(self.text)


@dataclass(frozen=True)
class Word(Phrase):
    def __post_init__(self) -> None:
        if len(_terms(self.text)) != 1:
            raise ValueError(f"not one word: {self.text!r}")


@dataclass(frozen=True)
class Prefix(Expression):
    """Any word that begins so."""

    text: str

    def __post_init__(self) -> None:
        if _terms(self.text) != [self.text.lower()]:
            raise ValueError(f"not the beginning of a word: {self.text!r}")


@dataclass(frozen=True)
class Field(Expression):
    name: str
    value: object

    def __post_init__(self) -> None:
        if self.value is None:
            raise ValueError("a field is compared with a value")


def _field(x: Field) -> Column:
    return F.coalesce(F.col(x.name) == F.lit(x.value), F.lit(False))


def normal(text: Column) -> Column:
    """The terms of text, each with a blank before and after it."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR, " "), F.lit(" "))


def conditions(expressions: list[Expression], text: str = "text") -> Column:
    """Array of booleans, one for each expression, from one normal form of the text."""

    def within(n: Column) -> Column:
        def leaf(x: Expression) -> Column:
            if isinstance(x, Field):
                return _field(x)
            if isinstance(x, Prefix):
                return F.contains(n, F.lit(f" {x.text.lower()}"))
            return F.contains(n, F.lit(f" {' '.join(x.words)} "))

        return F.array(*(_checked(x).build(leaf) for x in expressions))

    # the variable of the function is bound to the normal form, so it is computed once
    return F.transform(F.array(normal(F.col(text))), within)[0]


def condition(expression: Expression, text: str = "text") -> Column:
    return conditions([expression], text)[0]


def matches(docs: DataFrame, saved: Mapping[str, Expression], text: str = "text") -> DataFrame:
    """docs with `search`, the name of a saved search that they match: a row for each. One scan answers all of them."""
    names = sorted(saved)
    each = F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), conditions([saved[n] for n in names], text).alias("hit"))
    rows = docs.withColumn("search", F.explode(F.transform(F.filter(each, lambda x: x["hit"]), lambda x: x["name"])))
    return rows


def found(index: Index, expression: Expression) -> DataFrame:
    """doc_id, h of the documents of an index that match; fields are those that it was built with. Reads the postings of the words sought, and of all words for a prefix."""
    leaves = list(dict.fromkeys(x for x in _checked(expression).leaves() if not isinstance(x, Field)))
    words = [w for x in leaves if isinstance(x, Phrase) for w in x.words]
    prefixes = [x.text.lower() for x in leaves if isinstance(x, Prefix)]
    named = {x: f"f{i}" for i, x in enumerate(leaves)}
    docs = index.documents
    if leaves:
        rows = index.of(words)
        if prefixes:
            begins = reduce(lambda a, b: a | b, (F.col("term").startswith(p) for p in prefixes))
            rows = index.postings.drop("bucket").where(F.col("term").isin(sorted(set(words))) | begins)

        def flag(x: Expression) -> Column:
            if isinstance(x, Prefix):
                return F.bool_or(F.col("term").startswith(x.text.lower()))
            if len(x.words) == 1:
                return F.bool_or(F.col("term") == x.words[0])
            return F.size(starts(x.words)) > 0

        flags = rows.groupBy("doc_id", "h").agg(*(flag(x).alias(n) for x, n in named.items()))
        docs = docs.join(flags, ["doc_id", "h"], "left")
    return docs.where(expression.build(lambda x: _field(x) if isinstance(x, Field) else F.coalesce(F.col(named[x]), F.lit(False)))).select("doc_id", "h")
