"""The queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from prosewright.llm import decontamination, embedding_dedup, licences, line_dedup, packing, pii, quality, sharding, simhash, toxicity

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "packing_conversations": packing.packing_conversations,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_licences": licences.op8_licences,
    "op9_pii": pii.op9_pii,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL = {"op2_line_dedup": line_dedup.oracle(), "op8_licences": licences.oracle()}
