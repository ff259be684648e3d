"""op5: all documents mixed to the weights 5, 2, 1 of their sources."""

from __future__ import annotations

from tickloom.llm.common import read
from tickloom.llm.mixing import mix_sources


def op5_mix_sources(spark, sf_dir):
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
