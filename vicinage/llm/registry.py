"""Queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from vicinage.llm import chat, cotraining, elkan, language, media, mixing, near_dup, packing, parity, quality_rules, repeats, toxicity, trie


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_packing": packing.op3_packing,
        "op4_media": media.op4_media,
        "op5_near_dup": near_dup.op5_near_dup,
        "op6_language": language.op6_language,
        "op7_repeats": repeats.op7_repeats,
        "op8_chat": chat.op8_chat,
        "op9_mixing": mixing.op9_mixing,
        "op10_quality_classifier": cotraining.op10_quality_classifier,
        "op11_jaccard_join": parity.op11_jaccard_join,
        "op12_vector_codes": elkan.op12_vector_codes,
        "op13_prefix_trie": trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_near_dup": parity.OP5_SQL,
        "op8_chat": chat.OP8_SQL,
        "op9_mixing": mixing.OP9_SQL,
        "op11_jaccard_join": parity.OP11_SQL,
        "op12_vector_codes": elkan.OP12_SQL,
        "op13_prefix_trie": trie.OP13_SQL,
    }
