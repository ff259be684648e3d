"""op8: secret spans of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm.common import read
from tickloom.llm.secrets import scan_secrets


def op8_secret_scan(spark, sf_dir):
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return scan_secrets(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", listed.alias("spans"), "n_guess")
