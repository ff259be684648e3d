"""A training-corpus pipeline over the operators of tickloom.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame; ``run`` writes each
result as Parquet below the shared folder and reads it again as the next stage's docs. All stages but the last return the columns
of documents. Every stage takes nulls, empty texts, repeated rows and empty tables as its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import read
from tickloom.llm.jaccard import JaccardSpec
from tickloom.llm.stages import balanced_mix, one_of_each_group, packed, without_secrets, without_toxic
from tickloom.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The lexicon is learned from the labelled rows of ``docs``."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return one_of_each_group(docs, JaccardSpec(words=5, num=80, den=100))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret spans are replaced in the texts; every document stays, and n_chars follows the text."""
    return without_secrets(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its budget of words: documents are left out or repeated, and one per source is cut at the budget."""
    return balanced_mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids. The sequences with their ids stay below the shared folder, in a folder
    whose name ends with _sequences, as sequence_id, ids and pieces; the result is read from them, so its inputFiles() lie there."""
    return packed(docs, f"{shared_dir(spark)}_sequences")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_to_weights),
    ("packing", pack_windows),
]

#: SQL can express neither the learned lexicon nor the tokenizer; tests/llm/test_pipeline.py holds each stage against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
