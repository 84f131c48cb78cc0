"""Column expressions on text. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the title element of a page.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def occurrences(text: Column, keyword: str) -> Column:
    """Non-overlapping occurrences of keyword, case ignored; 0 for a null text or an empty keyword."""
    if not keyword:
        return F.lit(0).cast("long")
    low = F.lower(F.coalesce(text, F.lit("")))
    gap = F.length(low) - F.length(F.replace(low, F.lit(keyword.lower()), F.lit("")))
    return F.floor(gap / F.lit(len(keyword))).cast("long")


def contains_keyword(text: Column, keyword: str) -> Column:
    """Substring match, case ignored (our rule; none is published). Null text: false. Empty keyword: true for any text."""
    return F.coalesce(F.contains(F.lower(text), F.lit(keyword.lower())), F.lit(False))


def has_token(text: Column, *tokens: str) -> Column:
    """Whole-token match of any of tokens, case ignored; letters, digits and _ of any script bound a token, so 14k is not 4k. A plain search for the tokens comes first and spares most texts the pattern."""
    quoted = "|".join("".join(f"\\{c}" if not c.isalnum() else c for c in t.lower()) for t in tokens)
    low = F.lower(text)
    near = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in tokens], F.lit(False))
    return F.coalesce(near & low.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({quoted})($|[^\p{{L}}\p{{N}}_])"), F.lit(False))


def page_title(html: Column) -> Column:
    """Text of the first title element, trimmed; empty if there is none, null for null."""
    return F.trim(F.regexp_extract(html, TITLE, 1))
