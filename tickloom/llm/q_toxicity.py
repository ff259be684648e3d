"""op10: toxicity scores of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm.common import read
from tickloom.llm.toxicity import held_out, learn_lexicon, score_toxicity

#: labelled rows that the lexicon is learned from, at most
ROWS = 20_000


def op10_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn_lexicon(docs, read(spark, sf_dir, "labels"), ROWS)
    scored = score_toxicity(docs, lexicon)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
