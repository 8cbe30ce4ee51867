"""The queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import chat, language_id, lattice_lm, minhash, mixing, packing, pii, quality, token_files, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_pii_pseudonyms": pii.op3_pii_pseudonyms,
    "op4_token_files": token_files.op4_token_files,
    "op5_exact_top_k": topk.op5_exact_top_k,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op9_chat_format": chat.op9_chat_format,
    "op10_lattice_lm": lattice_lm.op10_lattice_lm,
    "op7_language_id": language_id.op7_language_id,
    "op8_quality_rules": quality.op8_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_top_k": topk.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op9_chat_format": chat.ORACLE,
}
