"""The corpus operators as queries over whole tables, with the SQL that checks them where SQL can say it."""

from __future__ import annotations

from tallyframe.llm import bpe, html_wrapper, langid_ppm, line_dedup, lm_interp, media_matroska, mixing, quality_qda, quality_rules, simhash

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_simhash": simhash.op3,
    "op4_quality_qda": quality_qda.op4,
    "op5_quality_rules": quality_rules.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_matroska": media_matroska.op7,
    "op8_html_wrapper": html_wrapper.op8,
    "op9_interpolated_lm": lm_interp.op9,
    "op10_language_id": langid_ppm.op10,
}

ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
}
