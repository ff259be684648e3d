"""op12: base and lattice log probabilities of all documents."""

from __future__ import annotations

import public_tokenizers

from tickloom.llm.common import read
from tickloom.llm.lattice import score_documents


def op12_lattice_score(spark, sf_dir, pieces: str | None = None):
    return score_documents(read(spark, sf_dir, "documents"), pieces or public_tokenizers.path("piece_bpe_32k.model"))
