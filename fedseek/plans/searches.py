"""Queries of the index and of search expressions, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedseek.operators import expressions, index, typo
from fedseek.operators.expressions import Field, Phrase, Prefix, Word
from fedseek.plans.bindings import NORMAL, WORDS, documents_index
from fedseek.sources.tables import table

TERMS, PHRASE, K = ["the", "der", "ou", "la"], "of the", 100

SEARCHES = {
    "all": Word("the") & Word("of"),
    "any": Word("der") | Word("la"),
    "but": Word("the") & ~Word("and"),
    "phrase": Phrase("of the"),
    "prefix": Prefix("thin") & ~Word("de"),
    "field": Field("lang", "en") & Phrase("the and"),
    "none": ~(Word("the") | Word("de")),
    "nested": (Phrase("of the") | Word("und")) & ~(Field("lang", "fr") | Word("that")),
}
_SQL = {
    "all": "contains(n, ' the ') AND contains(n, ' of ')",
    "any": "contains(n, ' der ') OR contains(n, ' la ')",
    "but": "contains(n, ' the ') AND NOT contains(n, ' and ')",
    "phrase": "contains(n, ' of the ')",
    "prefix": "contains(n, ' thin') AND NOT contains(n, ' de ')",
    "field": "coalesce(lang = 'en', false) AND contains(n, ' the and ')",
    "none": "NOT (contains(n, ' the ') OR contains(n, ' de '))",
    "nested": "(contains(n, ' of the ') OR contains(n, ' und ')) AND NOT (coalesce(lang = 'fr', false) OR contains(n, ' that '))",
}


def _indexed(spark, d) -> DataFrame:
    own = documents_index(spark, d)
    return reduce(DataFrame.unionByName, (expressions.found(own, x).select(F.lit(n).alias("search"), "doc_id") for n, x in SEARCHES.items()))


def _typos(spark, d) -> DataFrame:
    """Words of the benchmark's questions as keywords, with the terms of documents that they may be meant for."""
    words = table(spark, d, "benchmark").select(F.explode(index.terms_in(F.col("text"))).alias("word"))
    return typo.neighbours(words, documents_index(spark, d).terms)


QUERIES = {
    "a2_index_terms": lambda s, d: documents_index(s, d).terms,
    "a2_phrase": lambda s, d: index.phrase(documents_index(s, d), PHRASE.split()).select("doc_id", "tf"),
    "a2_searches": lambda s, d: expressions.matches(table(s, d, "documents"), SEARCHES).select("search", "doc_id"),
    "a2_searches_indexed": _indexed,
    "a2_typos": _typos,
    "a5_bm25": lambda s, d: index.best(documents_index(s, d), TERMS, K),
}

_IN = ", ".join(f"'{t}'" for t in TERMS)
_MATCHES = " UNION ALL ".join(f"SELECT '{n}' AS search, doc_id FROM normal WHERE {c}" for n, c in _SQL.items())
_SEARCHES = f"WITH normal AS (SELECT doc_id, lang, {NORMAL} AS n FROM documents WHERE doc_id IS NOT NULL) {_MATCHES}"
_BM25 = f"""
WITH texts AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
total AS (SELECT count(*) AS docs, sum(len(ws))::double / count(*) AS average FROM texts),
postings AS (SELECT doc_id, n, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM texts) WHERE w IN ({_IN}) GROUP BY ALL),
weights AS (SELECT w, ln(1 + (docs - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM postings, total GROUP BY w, docs),
scores AS (SELECT doc_id, sum(round(idf * (tf * 2.2e0) / (tf + 1.2e0 * (0.25e0 + 0.75e0 * n / average)) * 1000000)::bigint)::bigint AS score FROM postings JOIN weights USING (w), total GROUP BY doc_id)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::int AS rank FROM scores ORDER BY score DESC, doc_id LIMIT {K}
"""

#: levenshtein counts bytes there, so characters beyond ASCII first become signs that no term has: capital letters and punctuation.
_TYPOS = f"""
WITH words AS (SELECT DISTINCT unnest({WORDS}) AS word FROM benchmark),
terms AS (SELECT DISTINCT unnest({WORDS}) AS term FROM documents WHERE doc_id IS NOT NULL),
letters AS (SELECT string_agg(c, '' ORDER BY c) AS far FROM (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM (SELECT word FROM words UNION SELECT term FROM terms)) WHERE strlen(c) > 1),
signs AS (SELECT far, left('ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^{{|}}~', length(far)) AS near FROM letters),
w AS (SELECT word, translate(word, coalesce(far, ''), coalesce(near, '')) AS a FROM words, signs),
t AS (SELECT term, translate(term, coalesce(far, ''), coalesce(near, '')) AS b FROM terms, signs)
SELECT word, term, levenshtein(a, b)::int AS distance FROM w JOIN t ON abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= 2
"""

ORACLES = {
    "a2_index_terms": f"SELECT w AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({WORDS}) AS w FROM documents WHERE doc_id IS NOT NULL) GROUP BY w",
    "a2_phrase": f"SELECT doc_id, len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'of' AND ws[i + 1] = 'the'))::int AS tf FROM (SELECT doc_id, {WORDS} AS ws FROM documents) WHERE tf > 0",
    "a2_searches": _SEARCHES,
    "a2_searches_indexed": _SEARCHES,
    "a2_typos": _TYPOS,
    "a5_bm25": _BM25,
}
