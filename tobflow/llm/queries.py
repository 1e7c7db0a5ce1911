"""The registered corpus queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from tobflow.llm import bpe, conversation, decontam, fill_middle, line_dedup, near_dup, packing, quality, suffix_dedup, token_store, toxicity, vector_dedup, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_token_store": token_store.op2_token_store,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_near_dup": near_dup.op4_near_dup,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_quality": quality.op6_quality,
    "op7_warc": warc.op7_warc,
    "op8_packing": packing.op8_packing,
    "op9_decontam": decontam.op9_decontam,
    "op10_vector_dedup": vector_dedup.op10_vector_dedup,
    "op11_conversation_repair": conversation.op11_conversation_repair,
    "op12_bpe": bpe.op12_bpe,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_decontam": decontam.OP9_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
