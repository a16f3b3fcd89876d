"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, filter_audit, mixing, packing, perplexity, pii, quality_rules, sharding, simhash, substrings, tokens, warc, whitening

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_personal_data": pii.op2_personal_data,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_rendezvous_sharding": sharding.op5_rendezvous_sharding,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_token_lengths": tokens.op7_token_lengths,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_quality_perplexity": perplexity.op9_quality_perplexity,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_warc_archives": warc.op12_warc_archives,
    "op13_filter_interaction": filter_audit.op13_filter_interaction,
}

ORACLES = {
    "op3_mix_sources": mixing.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op12_warc_archives": warc.SQL,
    "op13_filter_interaction": filter_audit.SQL,
}
