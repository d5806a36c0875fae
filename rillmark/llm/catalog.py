"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from rillmark.llm import chat, embeddings, fingerprint, packing, passages, pieces, quality, simhash, tokens, toxicity

QUERIES = {
    "op1_embeddings": embeddings.op1,
    "op2_chat": chat.op2,
    "op3_packing": packing.op3,
    "op4_tokens": tokens.op4,
    "op5_fingerprints": fingerprint.op5,
    "op6_passages": passages.op6,
    "op7_quality": quality.op7,
    "op8_simhash": simhash.op8,
    "op9_sentencepiece": pieces.op9,
    "op10_toxicity": toxicity.op10,
}
ORACLE_SQL: dict[str, str] = {
    "op1_embeddings": embeddings.OP1_SQL,
    "op2_chat": chat.OP2_SQL,
}
