"""The corpus pipeline: toxicity, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of documents; the
last returns the pieces of packed sequences. Near duplicates are documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more; of each connected group the document with the smallest id stays.

Rows with a null doc_id, equal rows, null and empty texts go through each stage as its operator defines; extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import jaccard_join, line_rules, packing, toxicity
from tidewatch.llm.common import read, stash, worker_files
from tidewatch.llm.tokens import public_vocabulary

NEAR_SHINGLE, NEAR_NUMERATOR = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. The model learns from the labels of the corpus; documents that score 0.7 or more go."""
    worker_files(spark, "tidewatch")
    net = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, net)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Base rules are decided row by row; the texts that stay go on without the lines repeated on their host (n_chars is the count before)."""
    return line_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. One document of each group stays."""
    worker_files(spark, "tidewatch")
    return jaccard_join.keep_one(docs, stash(jaccard_join.jaccard_components(docs, NEAR_SHINGLE, NEAR_NUMERATOR), "groups"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, on sequences of up to 2048 tokens."""
    worker_files(spark, "tidewatch")
    return packing.pack_documents(docs, public_vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: A trained network and a tokenizer can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
