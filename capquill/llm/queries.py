"""Registry of the training-data queries and of their SQL."""

from capquill.llm import (
    chat_format,
    decontamination,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    prefix_trie,
    quality_rules,
    sharding,
    substring_dedup,
    suffix_dedup,
    token_counts,
    whitening,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_sharding": sharding.op8_sharding,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE = {
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op6_chat_format": chat_format.ORACLE_SQL,
    "op7_decontamination": decontamination.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
}
