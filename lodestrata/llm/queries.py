"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_extract, langid, line_dedup, lm_score, mixing, quality_crf, simhash, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_langid": langid.op5_langid,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_quality_crf": quality_crf.op7_quality_crf,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_html_extract": html_extract.op10_html_extract,
}

ORACLE = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op8_mixing": mixing.ORACLE,
}
