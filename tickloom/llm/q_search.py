"""op2 and op6: BM25 top-k for every fiftieth document, and license notices of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm.common import read
from tickloom.llm.licenses import scan_licenses
from tickloom.llm.search import top_k_search


def op2_top_k_search(spark, sf_dir):
    """Queries: the whole texts of documents with an id divisible by 50, against all documents."""
    docs = read(spark, sf_dir, "documents")
    return top_k_search(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))


def op6_license_scan(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"))
