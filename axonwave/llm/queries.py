"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from axonwave.llm import op01_consensus_extraction, op02_piece_encoding, op03_repeat_intervals, op04_fragment_join, op05_pivotal_mix, op06_radix_dedup, op07_url_reputation, op08_warc, op09_line_frequency, op10_line_dedup, op11_filter_audit, op12_best_fit_packing

MODULES = {
    "op1_consensus_extraction": op01_consensus_extraction,
    "op2_piece_encoding": op02_piece_encoding,
    "op3_repeat_intervals": op03_repeat_intervals,
    "op4_fragment_join": op04_fragment_join,
    "op5_pivotal_mix": op05_pivotal_mix,
    "op6_radix_dedup": op06_radix_dedup,
    "op7_url_reputation": op07_url_reputation,
    "op8_warc": op08_warc,
    "op9_line_frequency": op09_line_frequency,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_best_fit_packing": op12_best_fit_packing,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict:
    return {name: m.ORACLE for name, m in MODULES.items() if hasattr(m, "ORACLE")}
