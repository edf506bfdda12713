"""The queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from pagelens.llm import op1, op10, op11, op12, op13, op2, op3, op4, op5, op6, op7, op8, op9

QUERIES = {
    "op1_exact_dedup": op1.query,
    "op2_byte_bpe": op2.query,
    "op3_near_dedup": op3.query,
    "op4_lm_scoring": op4.query,
    "op5_token_counts": op5.query,
    "op6_chat_format": op6.query,
    "op7_quality": op7.query,
    "op8_embedding_dedup": op8.query,
    "op9_packing": op9.query,
    "op10_language_id": op10.query,
    "op11_hard_negatives": op11.query,
    "op12_url_rules": op12.query,
    "op13_source_audit": op13.query,
}

#: The others can't be said in SQL; tests hold them to brute force, a round trip or labels.
ORACLE = {
    "op1_exact_dedup": op1.ORACLE,
    "op3_near_dedup": op3.ORACLE,
    "op6_chat_format": op6.ORACLE,
    "op8_embedding_dedup": op8.ORACLE,
    "op11_hard_negatives": op11.ORACLE,
    "op12_url_rules": op12.ORACLE,
    "op13_source_audit": op13.ORACLE,
}
