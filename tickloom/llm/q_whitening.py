"""op13: the first four whitened components of all embeddings."""

from __future__ import annotations

from tickloom.llm.common import read
from tickloom.llm.whitening import whiten


def op13_whiten(spark, sf_dir):
    return whiten(read(spark, sf_dir, "embeddings"))
