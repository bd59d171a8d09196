"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, lines, matroska, mixing, setjoin, sharding, topk, toxicity, urlfilter

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_pfair_mixing": mixing.op3_pfair_mixing,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_minhash_near_dedup": setjoin.op5_minhash_near_dedup,
    "op6_balanced_sharding": sharding.op6_balanced_sharding,
    "op7_matroska": matroska.op7_matroska,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_url_filters": urlfilter.op10_url_filters,
}
ORACLES = chat.ORACLE | setjoin.ORACLE | topk.ORACLE | urlfilter.ORACLE
