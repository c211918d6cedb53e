"""The registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from siftrank.llm import (
    conversations,
    decontaminate,
    embeddings,
    pages,
    periods,
    pieces,
    quality,
    repeats,
    sanitise,
    secrets,
    sharding,
    simhash,
    toxicity,
)

QUERIES = {
    "op1_repeats": repeats.query,
    "op2_simhash": simhash.query,
    "op3_pieces": pieces.query,
    "op4_decontamination": decontaminate.query,
    "op5_quality_rules": quality.query,
    "op6_sharding": sharding.query,
    "op7_pages": pages.query,
    "op8_toxicity": toxicity.query,
    "op9_secrets": secrets.query,
    "op10_sanitisation": sanitise.query,
    "op11_periods": periods.query,
    "op12_embeddings": embeddings.query,
    "op13_conversations": conversations.query,
}

SQL: dict[str, str] = {
    "op4_decontamination": decontaminate.SQL,
    "op6_sharding": sharding.SQL,
}
