"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm import exact_dedup, html_crf, langid, line_dedup, packing, sharding, simhash, sp_lattice, spotsigs, suffix_dedup

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_language_id": langid.op2_language_id,
    "op3_spotsigs": spotsigs.op3_spotsigs,
    "op4_html_extraction": html_crf.op4_html_extraction,
    "op5_sharding": sharding.op5_sharding,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_sentencepiece": sp_lattice.op8_sentencepiece,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
}
