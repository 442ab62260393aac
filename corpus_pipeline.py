"""The corpus pipeline: documents through five operators, each stage written and read again."""

from __future__ import annotations

from quillmark.llm import decontaminate, langid, mixing, ngram_join, sharding
from quillmark.llm.common import cut, table

STAGES = [
    ("language_id", langid.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: Trained models, MinHash and the Hilbert curve's checksums have no SQL; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Apply the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
