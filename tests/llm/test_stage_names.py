"""Stages keep columns whose names they could use themselves, and the token cache gives the tokenizer's ids."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import common, jaccard, stages, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, toxicity int, mix_key int, mix_whole int, mix_rest int, mix_copy int, score int"


def rows():
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)] + [None, "", " "]
    return [(i, t, "en", f"s{i % 2}", None if t is None else len(t), "k", 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)]


def test_clashing_names(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    found = stages.without_toxic(docs, labels)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(rows(), key=repr) and found.columns == docs.columns
    one = stages.one_of_each_group(docs, jaccard.JaccardSpec(words=5, num=80, den=100))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(rows(), key=repr) and one.columns == docs.columns
    mixed = stages.balanced_mix(docs)
    assert mixed.columns == docs.columns and {r["row_key"] for r in mixed.collect()} == {"k"}
    assert stages.without_secrets(docs).columns == docs.columns


def test_unused():
    assert common.unused(["a", "B"], "c") == "c" and common.unused(["a", "A_"], "a") == "a__"


@pytest.mark.parametrize("size", [4, 500_000])
def test_cached_ids_equal_the_tokenizer(monkeypatch, size):
    monkeypatch.setattr(tokens, "CACHE", size)
    monkeypatch.setattr(tokens, "_STATE", {})
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, coder = Tokenizer.from_file(path), tokens.TokenCoder(path)
    texts = ["", "Hello  World's\tfoo-bar\n42 x1y2 it'll 'S", "naïve Café über ñandú", "привет мир мир", "日本語 text", "a" * 300 + " b", "Σίσυφος ΟΔΟΣ", "<|endoftext|> x", "é combining", "!?.. ...wow's't", "the the the"] * 2
    for t in texts:
        want = plain.encode(t, add_special_tokens=False).ids
        assert coder.ids(t) == b"".join(i.to_bytes(4, "little") for i in want), t
