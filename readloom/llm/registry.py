"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import bitsliced, chat, language, media, mixing, near_dup, packing, passages, quality, token_files

QUERIES = {
    "op1_bit_sliced_top_k": bitsliced.op1_bit_sliced_top_k,
    "op2_minhash_near_dedup": near_dup.op2_minhash_near_dedup,
    "op3_token_stream_files": token_files.op3_token_stream_files,
    "op4_media_columns": media.op4_media_columns,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_substring_dedup": passages.op6_substring_dedup,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_language_id": language.op8_language_id,
    "op9_soft_mixing": mixing.op9_soft_mixing,
    "op10_quality_classifier": quality.op10_quality_classifier,
}

ORACLES = {
    "op1_bit_sliced_top_k": bitsliced.OP1_SQL,
    "op2_minhash_near_dedup": near_dup.OP2_SQL,
    "op7_chat_formatting": chat.OP7_SQL,
}
