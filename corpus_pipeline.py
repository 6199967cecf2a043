"""The corpus pipeline: quality rules, line dedup, near-duplicates, personal data, packing.

Every stage takes what its predecessor kept. All but the last return the columns
of ``documents``; the last returns a row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import line_dedup, packing, pii, quality_rules, simhash

#: SQL can't express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that a host repeats too often go from the texts."""
    return quality_rules.apply_quality_rules(docs)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of alike lines one stays; documents that have no other line go."""
    return line_dedup.drop_duplicate_lines(docs, emptied=False)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates one document stays."""
    return simhash.drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", unique_lines),
    ("near-duplicates", unique_documents),
    ("personal data", private),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder and read again."""
    from siltworks.llm.common import table

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = table(docs)
    return docs
