"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from millrace.llm import chat, cotraining, decontamination, infilling, jaccard, mixing, packing, quality, scoring, search, secrets, sharding, substrings

QUERIES = {
    "op1_jaccard": jaccard.op1_jaccard,
    "op2_substrings": substrings.op2_substrings,
    "op2_lines": substrings.op2_lines,
    "op3_secrets": secrets.op3_secrets,
    "op3_base": secrets.op3_base,
    "op4_chat": chat.op4_chat,
    "op5_scoring": scoring.op5_scoring,
    "op5_bigrams": scoring.op5_bigrams,
    "op6_sharding": sharding.op6_sharding,
    "op7_cotraining": cotraining.op7_cotraining,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_search": search.op11_search,
    "op12_packing": packing.op12_packing,
    "op13_infilling": infilling.op13_infilling,
}

SQL = {
    "op1_jaccard": jaccard.SQL,
    "op3_base": secrets.SQL_BASE,
    "op4_chat": chat.SQL,
    "op5_scoring": scoring.SQL,
    "op5_bigrams": scoring.SQL_BIGRAMS,
    "op6_sharding": sharding.SQL,
    "op8_mixing": mixing.SQL,
    "op9_quality": quality.SQL,
    "op10_decontamination": decontamination.SQL,
    "op11_search": search.SQL,
    "op13_infilling": infilling.SQL,
}
