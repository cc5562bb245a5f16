"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import language_id, line_dedup, lm_scoring, media, mixing, ngram_join, packing, quality, token_counts, token_ids

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_token_ids": token_ids.op4_token_ids,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_packing": packing.op6_packing,
    "op7_media": media.op7_media,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op9_mixing": mixing.SQL,
}
