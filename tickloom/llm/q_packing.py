"""op7: all documents packed into sequences of 2048 ids."""

from __future__ import annotations

import public_tokenizers

from tickloom.llm.common import read
from tickloom.llm.packing import placed_pieces, sequences


def op7_pack_sequences(spark, sf_dir, tokenizer: str | None = None):
    """Where each piece lies in the written sequences, and the checksum of its ids there."""
    return placed_pieces(sequences(read(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json")))
