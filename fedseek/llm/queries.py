"""One query per operator, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fedseek.llm.chat import op9_chat
from fedseek.llm.decontaminate import op6_decontaminate
from fedseek.llm.extraction import op12_html_extraction
from fedseek.llm.fingerprint import op1_fingerprints
from fedseek.llm.importance import ORACLE as IMPORTANCE
from fedseek.llm.importance import op11_importance
from fedseek.llm.language import op10_language
from fedseek.llm.language_model import op4_lm_scores
from fedseek.llm.lines import ORACLE as LINES
from fedseek.llm.lines import op2_line_dedup
from fedseek.llm.manifest import ORACLE as MANIFEST
from fedseek.llm.manifest import op13_manifest
from fedseek.llm.mixing import op7_mixing
from fedseek.llm.ngram_join import ORACLE as JOIN
from fedseek.llm.ngram_join import op8_ngram_join
from fedseek.llm.repeats import ORACLE as REPEATS
from fedseek.llm.repeats import op3_repeats
from fedseek.llm.tokens import op5_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_line_dedup,
        op3_repeats,
        op4_lm_scores,
        op5_token_counts,
        op6_decontaminate,
        op7_mixing,
        op8_ngram_join,
        op9_chat,
        op10_language,
        op11_importance,
        op12_html_extraction,
        op13_manifest,
    )
}

ORACLES: dict[str, str] = {"op2_line_dedup": LINES, "op3_repeats": REPEATS, "op8_ngram_join": JOIN, "op11_importance": IMPORTANCE, "op13_manifest": MANIFEST}
