"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_trie, embedding_dedup, gif, line_dedup, ngram_join, packing, pii, quality, sharding, suffix_dedup, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_bpe_codec": bpe.op2_bpe_codec,
    "op3_collision_counting": embedding_dedup.op3_collision_counting,
    "op4_best_two_fit_packing": packing.op4_best_two_fit_packing,
    "op5_weak_supervision_pii": pii.op5_weak_supervision_pii,
    "op6_log_template_lines": line_dedup.op6_log_template_lines,
    "op7_hash_tree_sharding": sharding.op7_hash_tree_sharding,
    "op8_gif_columns": gif.op8_gif_columns,
    "op9_string_kernel_toxicity": toxicity.op9_string_kernel_toxicity,
    "op10_grouped_prefix_join": ngram_join.op10_grouped_prefix_join,
    "op11_positive_unlabelled_quality": quality.op11_positive_unlabelled_quality,
    "op12_conversation_prefix_trie": conversation_trie.op12_conversation_prefix_trie,
    "op13_refined_whitening": whitening.op13_refined_whitening,
}

SQL: dict[str, Callable[[], str]] = {
    "op6_log_template_lines": line_dedup.line_dedup_sql,
    "op7_hash_tree_sharding": sharding.sharding_sql,
    "op12_conversation_prefix_trie": conversation_trie.trie_sql,
}
