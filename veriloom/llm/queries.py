"""Registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veriloom.llm import chat_repair, chat_tools, cube_mixing, kn_quality, langid_ftrl, line_dedup, lsh_forest, media_shards, pca_tiles, pii_bootstrap, prefix_trie, rank_bpe, secret_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_tools": chat_tools.op1,
    "op2_pii_bootstrap": pii_bootstrap.op2,
    "op3_line_dedup": line_dedup.op3,
    "op4_cube_mixing": cube_mixing.op4,
    "op5_secret_scan": secret_scan.op5,
    "op6_lsh_forest": lsh_forest.op6,
    "op7_media_shards": media_shards.op7,
    "op8_rank_bpe": rank_bpe.op8,
    "op9_langid_ftrl": langid_ftrl.op9,
    "op10_kn_quality": kn_quality.op10,
    "op11_chat_repair": chat_repair.op11,
    "op12_pca_tiles": pca_tiles.op12,
    "op13_prefix_trie": prefix_trie.op13,
}

ORACLES: dict[str, str] = {"op1_chat_tools": chat_tools.OP1_SQL, "op11_chat_repair": chat_repair.OP11_SQL, "op12_pca_tiles": pca_tiles.OP12_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
