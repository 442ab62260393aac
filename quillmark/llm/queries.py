"""Queries over the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, langid, line_dedup, mixing, ngram_join, quality, secrets, sharding, suffix_dedup

QUERIES = {
    "op1_ngram_join": ngram_join.op1,
    "op2_embedding_dedup": embedding_dedup.op2,
    "op3_language_id": langid.op3,
    "op4_mix_sources": mixing.op4,
    "op5_decontaminate": decontaminate.op5,
    "op6_secret_scan": secrets.op6,
    "op7_quality": quality.op7,
    "op8_hilbert_shards": sharding.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_suffix_dedup": suffix_dedup.op10,
}

ORACLE: dict = {}
