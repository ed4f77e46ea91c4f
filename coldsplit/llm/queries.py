"""Registry of the training-data queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from coldsplit.llm import fp_search, host_rules, kd_sharding, line_dedup, mixing, paragraph_dedup, phrases, secrets_scan, sentencepiece_fst, simhash, topk_nra, toxicity, wrapper_induction

REGISTRY = {
    "op1_sentencepiece": (sentencepiece_fst.op1_query, None),
    "op2_topk_nra": (topk_nra.op2_query, topk_nra.OP2_SQL),
    "op3_line_dedup": (line_dedup.op3_query, line_dedup.OP3_SQL),
    "op4_paragraph_dedup": (paragraph_dedup.op4_query, None),
    "op5_host_rules": (host_rules.op5_query, host_rules.OP5_SQL),
    "op6_secret_scan": (secrets_scan.op6_query, None),
    "op7_toxicity": (toxicity.op7_query, None),
    "op8_kd_sharding": (kd_sharding.op8_query, None),
    "op9_simhash_near_dedup": (simhash.op9_query, None),
    "op10_mixing": (mixing.op10_query, mixing.OP10_SQL),
    "op11_html_wrapper": (wrapper_induction.op11_query, None),
    "op12_fp_search": (fp_search.op12_query, fp_search.OP12_SQL),
    "op13_phrases": (phrases.op13_query, phrases.OP13_SQL),
}
