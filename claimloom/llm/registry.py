"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, embeddings, mixing, ngramjoin, sharding, substrings, tokencounts, toxicity, urlfilter

QUERIES = {
    "op4_ngram_jaccard_join": ngramjoin.op4_ngram_jaccard_join,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op5_token_counts": tokencounts.op5_token_counts,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
    "op1_url_filters": urlfilter.op1_url_filters,
    "op2_sharding": sharding.op2_sharding,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
}

ORACLES = {
    "op8_chat_formatting": chat.ORACLE,
    "op10_embedding_near_dedup": embeddings.ORACLE,
    "op9_benchmark_decontamination": decontaminate.ORACLE,
}
