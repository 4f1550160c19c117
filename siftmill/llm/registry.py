"""Queries of this subpackage for the entry module: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from . import bpe, chosen_path, embedding_dedup, exact_dedup, html_extract, line_dedup, mixing, ngram_lm, suffix_dedup, toxicity

QUERIES = {
    "op1_embedding_dedup": (embedding_dedup.op1_embedding_dedup, None),
    "op2_bpe": (bpe.op2_bpe, None),
    "op3_mixing": (mixing.op3_mixing, None),
    "op4_html_extract": (html_extract.op4_html_extract, None),
    "op5_line_dedup": (line_dedup.op5_line_dedup, line_dedup.ORACLE),
    "op6_ngram_lm": (ngram_lm.op6_ngram_lm, None),
    "op7_suffix_dedup": (suffix_dedup.op7_suffix_dedup, None),
    "op8_toxicity": (toxicity.op8_toxicity, None),
    "op9_chosen_path": (chosen_path.op9_chosen_path, None),
    "op10_exact_dedup": (exact_dedup.op10_exact_dedup, exact_dedup.ORACLE),
}
