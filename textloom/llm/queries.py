"""All queries of the corpus operators, and the SQL that states the same where SQL can."""

from __future__ import annotations

from . import (
    op1_language,
    op2_fingerprints,
    op3_line_dedup,
    op4_toxicity,
    op5_warc,
    op6_packing,
    op7_decontamination,
    op8_preferences,
    op9_extraction,
    op10_jaccard_join,
    op11_spelling_variants,
    op12_sentencepiece,
    op13_fill_middle,
)

_MODULES = (
    op1_language,
    op2_fingerprints,
    op3_line_dedup,
    op4_toxicity,
    op5_warc,
    op6_packing,
    op7_decontamination,
    op8_preferences,
    op9_extraction,
    op10_jaccard_join,
    op11_spelling_variants,
    op12_sentencepiece,
    op13_fill_middle,
)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
