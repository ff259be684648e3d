"""The packed sequences hold the ids of all texts."""

import collections
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

import corpus_pipeline
from tickloom.llm import packing, q_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_sequences(texts, found, window=2048):
    """Every text's ids are in the sequences as often as it is in ``texts``; ``texts`` holds (doc_id, text)."""
    tok = Tokenizer.from_file(PATH)
    want = collections.Counter((i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in texts)
    pieces = collections.defaultdict(list)
    for r in found:
        assert sum(p.length for p in r.pieces) * 4 == len(r.ids) <= 4 * window
        for p in r.pieces:
            pieces[p.doc_id, p.doc_tokens].append((p.start, bytes(r.ids[4 * p.offset:4 * (p.offset + p.length)])))
    for (i, ids), n in want.items():
        mine = collections.Counter(pieces[i, len(ids) // 4])
        for start, part in list(mine):
            if ids[4 * start:4 * start + len(part)] != part:
                del mine[start, part]
        assert sum(len(part) * k for (_, part), k in mine.items()) == n * len(ids) and set(mine.values()) == {n}
    assert len({r.sequence_id for r in found}) == len(found)
    assert sum(len(r.ids) for r in found) == sum(len(ids) * n for (_, ids), n in want.items())


def test_query_and_pipeline_write_the_ids(spark, tmp_path):
    texts = [(1, "one two three " * 900), (2, "some other words"), (2, "some other words"), (3, None), (4, "ein Text 12"), (5, "word " * 5000), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for out in (q_packing.op7_pack_sequences(spark, str(tmp_path)), corpus_pipeline.pack_windows(spark, docs, str(tmp_path))):
        rows = spark.read.parquet(os.path.dirname(out.inputFiles()[0])).collect()
        check_sequences(texts, rows)
        got = collections.Counter(tuple(r) for r in out.collect())
        assert got == collections.Counter((p.doc_id, p.start, p.length, zlib.crc32(r.ids[4 * p.offset:4 * (p.offset + p.length)]), p.doc_tokens, r.sequence_id, p.offset) for r in rows for p in r.pieces)


def test_many_whole_windows_spread(spark):
    docs = spark.createDataFrame([(i, "word " * 20_000) for i in range(30)], "doc_id long, text string")
    pieces = packing.token_pieces(docs, PATH, with_ids=False).drop("ids")
    blocks = {r.sequence_id >> 20 for r in packing.pack(pieces, block=16).where("length = 2048").select("sequence_id").collect()}
    assert len(blocks) > 10


def test_many_texts_at_once_have_the_ids_of_whole_texts(monkeypatch):
    from tickloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 30)  # the table is cut again and again
    monkeypatch.setattr(tokens, "STEP", 7)
    monkeypatch.setattr(tokens, "_STATE", {})
    tok, coder = Tokenizer.from_file(PATH), tokens.TokenCoder(PATH)
    rng = random.Random(3)
    signs = ["a", "the", "ing", "É", "é", "ß", "don't", "'s", " ", " ", "\n", "\t", "7", "12", ".", ",", "w" * 80, "</w>", "<w>", "日本", "\x00", "\x1c", " ", "ς", "Σ", "İ", "е́", "é", "<|endoftext|>"]
    for k in range(30):
        texts = [None, "", " "] + ["".join(rng.choices(signs[:16 + k % 13], k=rng.randint(1, 30))) for _ in range(40)]
        ids, counts = coder.many(pa.array(texts, pa.string()))
        found = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in found] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_distinct_words_are_looked_up_together(monkeypatch):
    from tickloom.llm import tokens

    calls = []
    monkeypatch.setattr(tokens, "_STATE", {})
    coder = tokens.TokenCoder(PATH)
    real = tokens._Merges.ids
    monkeypatch.setattr(tokens._Merges, "ids", lambda self, pieces: calls.append(len(pieces)) or real(self, pieces))
    coder.many(pa.array(["some words, some more words"] * 500))
    coder.many(pa.array(["more words, some"]))
    assert calls == [4]  # some, words, the comma, more


def test_lower_case_and_white_space_of_plain_characters():
    from tickloom.llm import tokens

    plain = [chr(i) for i in range(0x2100) if tokens._PLAIN.fullmatch(chr(i))]
    assert pc.utf8_lower(pa.array(plain)).to_pylist() == [c.lower() for c in plain]
    assert [c for c in plain if not any(pc.ascii_split_whitespace(pa.array([c]))[0].as_py())] == [c for c in plain if not c.split()]


def test_long_words_are_not_kept(monkeypatch):
    from tickloom.llm import tokens

    monkeypatch.setattr(tokens, "BYTES", 4000)
    monkeypatch.setattr(tokens, "_STATE", {})
    coder = tokens.TokenCoder(PATH)
    long = "".join(random.Random(1).choices("qxzjkv", k=5000))
    assert coder.ids(f"short {long}") == np.array(Tokenizer.from_file(PATH).encode(f"short {long}", add_special_tokens=False).ids, "<u4").tobytes()
    assert coder.words.words.to_pylist() == ["short"]
