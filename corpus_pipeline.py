"""Corpus pipeline: documents -> accepted, deduplicated, redacted, mixed and packed training rows.

Every stage works on all rows its predecessor kept. ``run`` writes the result of each stage as Parquet
and rereads it as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelspark.llm import mixing, near_dedup, packing, quality_model, secret_scan
from parcelspark.llm.queries import table
from parcelspark.llm.store import stored

# the stages learn and iterate, so SQL cannot express them; tests compare with brute force
ORACLE_SQL = None


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents it rejects go. Null and empty texts are scored like any text, rows one by
    one; an empty table stays empty, extra columns stay as they are."""
    return quality_model.accepted(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup over 5-word shingles: one document of each group stays. Null, empty and wordless
    texts are in no group; of rows with equal id and text one stays; rows without an id all stay."""
    return near_dedup.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: secrets are replaced by a mark; n_chars is counted anew where the text changed. No row
    goes; null and empty texts stay as they are."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weighted fair queueing: each document as often as the mix takes it (not at all, or repeated). Null and
    empty texts hold no words and are not taken; null sources are one source."""
    return mixing.mixed_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets of least padding and token-budget batches. The result is the training data: each row
    carries its text and source, the number of its copy in the mix, and its bucket, batch and slot."""
    return packing.pack(docs, keep=("source", "text"))


STAGES = [
    ("quality", accept_quality),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
