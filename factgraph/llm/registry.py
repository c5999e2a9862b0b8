"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from factgraph.llm import chat, decontaminate, exact_dedup, fill_middle, html_text, importance, near_dedup, packing, quality, sharding, substring_dedup, token_counts, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_concat_cut": packing.op1_concat_cut,
        "op2_rank_merged_counts": token_counts.op2_rank_merged_counts,
        "op3_prefix_target_chats": chat.op3_prefix_target_chats,
        "op4_style_tree_text": html_text.op4_style_tree_text,
        "op5_window_repeats": substring_dedup.op5_window_repeats,
        "op6_jump_shards": sharding.op6_jump_shards,
        "op7_fast_sketch_near": near_dedup.op7_fast_sketch_near,
        "op8_attention_quality": quality.op8_attention_quality,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_qgram_leaks": decontaminate.op10_qgram_leaks,
        "op11_zstd_token_files": token_store.op11_zstd_token_files,
        "op12_fill_middle": fill_middle.op12_fill_middle,
        "op13_importance_resampling": importance.op13_importance_resampling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_prefix_target_chats": chat.SQL,
        "op5_window_repeats": substring_dedup.SQL,
        "op6_jump_shards": sharding.SQL,
        "op7_fast_sketch_near": near_dedup.SQL,
        "op9_exact_dedup": exact_dedup.SQL,
        "op12_fill_middle": fill_middle.SQL,
        "op13_importance_resampling": importance.SQL,
    }
