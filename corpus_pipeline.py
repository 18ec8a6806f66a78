"""The corpus pipeline: five stages over documents, each reading what its predecessor wrote.

Every stage takes any documents: null and empty texts, rows without doc_id or source, repeated rows, and an empty table.
All but the last return the columns they were given, columns of clashing names included, and change text and n_chars at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import near_dedup, packing, quality, secret_scan, toxicity
from marlstone.llm.common import shared_dir, table
from marlstone.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass; null and empty texts have too few words and go; rows of one doc_id, or without one, are judged each; a null
    source is a host of its own."""
    return quality.keep_good(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents not predicted toxic; null and empty texts score as texts without a match; repeated rows share their fate; without
    labels all stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its rows; five-word shingles and a similarity of 0.8, as for
    all stages on word shingles.  Null and empty texts and rows without doc_id are in no group and stay."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars counted anew; a null text stays null, with a null n_chars."""
    return secret_scan.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents; null and empty texts are one piece with the end token; repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("toxicity", toxic_documents), ("MinHash near-dedup", minhash_near_dedup), ("secret scans", secret_scans), ("packing", pack)]

#: The stages hold learned weights and a tokenizer, which SQL cannot express; tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is written to the shared folder and reread.  No documents give no
    pieces."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
