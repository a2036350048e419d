"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, filter_audit, hard_negatives, jaccard, langid, neighbours, packing, repeats, secret_scan, substrings, urls, warc

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_language_id": langid.op3_language_id,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_secret_scans": secret_scan.op5_secret_scans,
    "op6_nearest_neighbours": neighbours.op6_nearest_neighbours,
    "op7_warc": warc.op7_warc,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_url_filters": urls.op9_url_filters,
    "op10_suffix_array_dedup": repeats.op10_suffix_array_dedup,
    "op11_hard_negative_mining": hard_negatives.op11_hard_negative_mining,
    "op12_substring_dedup": substrings.op12_substring_dedup,
    "op13_filter_interaction_audit": filter_audit.op13_filter_interaction_audit,
}
ORACLES = {
    "op1_ngram_jaccard_join": jaccard.OP1_SQL,
    "op2_chat_formatting": chat.OP2_SQL,
    "op4_benchmark_decontamination": decontaminate.OP4_SQL,
    "op6_nearest_neighbours": neighbours.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op11_hard_negative_mining": hard_negatives.OP11_SQL,
    "op12_substring_dedup": substrings.OP12_SQL,
    "op13_filter_interaction_audit": filter_audit.OP13_SQL,
}
