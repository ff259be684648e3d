"""op11: tokens of two public vocabularies aligned over all documents."""

from __future__ import annotations

import public_tokenizers

from tickloom.llm.alignment import align_tokens
from tickloom.llm.common import read


def op11_align_tokenizers(spark, sf_dir, byte_level: str | None = None, pieces: str | None = None):
    """Counts and the groups' checksum per document."""
    byte_level, pieces = byte_level or public_tokenizers.path("byte_bpe_50k.json"), pieces or public_tokenizers.path("piece_bpe_32k.model")
    return align_tokens(read(spark, sf_dir, "documents"), byte_level, pieces).drop("groups")
