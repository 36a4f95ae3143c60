"""The text pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from tierblend.llm import bpe, decontaminate, neardup, quality, secrets
from tierblend.llm.base import table
from tierblend.session import settle


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return neardup.keep_one(docs, neardup.CORPUS_SHARE)


def decontamination_stage(spark, docs, sf_dir):
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark, docs, sf_dir):
    """Secrets are replaced in the texts."""
    return secrets.redact(docs)


def encoding_stage(spark, docs, sf_dir):
    """Ids of every text, with the digests of ids and of the decoded bytes."""
    return bpe.round_trip(docs, *bpe.multilingual())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("encoding", encoding_stage),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
