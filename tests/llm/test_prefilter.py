"""The prefilter of the secret scan lets through every text that a context pattern could find something in."""

import pyarrow as pa
import pytest

from tickloom.llm.secrets import _scan, redact_secrets

VALUE = "x9Kq2LmZ81vTrWp4Yd"
NAMES = (
    "pass password passwd passphrase passcode pwd secret token apikey api_key api-key accesskey access_key access-key privatekey private_key private-key "
    "authkey auth_key auth-key credential credentials clientsecret client_secret client-secret").split()
CONTEXTS = [f"{n}{sign}{VALUE}" for n in NAMES for sign in ("=", ": ", " := ", "' => ", '"]\t=\t"')]
CONTEXTS += [f"{h}{gap}{VALUE}" for h in ("Authorization: Basic", "authorization:basic", "AUTHORIZATION:\tBASIC", "Authorization: Bearer", "Bearer", "bearer") for gap in (" ", "\t")]
CONTEXTS += [f"see ftp://someone:{VALUE}@host/path"]


@pytest.mark.parametrize("text", CONTEXTS)
def test_each_context_alone(text):
    ((found, _, spans),) = _scan(pa.array([text]))
    assert found == text and any(text[s:e].endswith(VALUE) for s, e, _ in spans)


def test_basic_header_is_redacted(spark):
    docs = spark.createDataFrame([(1, f"GET / Authorization: Basic {VALUE} end")], "doc_id long, text string")
    assert redact_secrets(docs).first()["text"] == "GET / Authorization: Basic [SECRET] end"
