"""op11 against a token-by-token loop over whole texts, and its parts."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tickloom.llm import q_alignment
from tickloom.llm.alignment import Aligner, align_tokens
from tickloom.llm.dense import tree_sum
from tickloom.llm.perfect import PerfectHash

SF = "/root/testdata/sf0.001"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  b ", "a", "\n", "a \n b", "x\n\ny  z\t", "▁ a", "a▁b c", "one ▁", "<|endoftext|> <s> </s> <unk> <0x0A>", "naïve café ﬁ ２", "日本語 の 文", "🙂 🙂",
       "don't we'll  it 's", "a b   c", "\x1c x \x85 y", "a\x00b", "w" * 3000, "x" * 70 + " y", "word " * 2000, "a b\r\n c", "᠎  x", "́a ́", "trail   "]


def by_loops(texts):
    """The rows of all texts, whole texts through both libraries."""
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    from_shown = {}
    extra = 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            from_shown[chr(x)] = x
        else:
            from_shown[chr(256 + extra)] = x
            extra += 1
    rows, count = [], collections.Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(from_shown[c] for c in names[i]) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            rows.append(None)
            continue
        end_a, end_b, at = {}, {}, 0
        for k, x in enumerate(bytes_a):
            at += len(x)
            end_a[at] = k
        at = 0
        for k, x in enumerate(bytes_b):
            at += len(x)
            end_b[at] = k
        groups, links, i, j = [], [], 0, 0
        for end in sorted(end_a.keys() & end_b.keys()):
            groups.append(",".join(map(str, ids_a[i:end_a[end] + 1])) + "|" + ",".join(map(str, ids_b[j:end_b[end] + 1])))
            i, j = end_a[end] + 1, end_b[end] + 1
            links.append((ids_a[end_a[end]], ids_b[end_b[end]]))
        count.update(links)
        rows.append((len(ids_a), len(ids_b), groups, links))
    highest = collections.Counter()
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = r
            out.append((n_a, n_b, len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_against_loops(spark):
    given = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    found = q_alignment.op11_align_tokenizers(spark, SF).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in found] == [i for i, _ in given]
    assert [tuple(r[n] for n in NAMES) for r in found] == by_loops([t for _, t in given])


def test_odd_texts_null_ids_repeats_and_clashing_names(spark):
    texts = ODD + ["a", "word " * 2000]
    rows = [(None if k == 4 else k, t, 1, "x", 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, groups string, pair long").repartition(3)
    found = align_tokens(docs, *FILES)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"]
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in found.collect()}
    assert got == {r[0]: want for r, want in zip(rows, by_loops(texts))}
    assert got[ODD.index("▁ a")] == (0, 0, 0, 0, 0, 0, "")
    assert align_tokens(docs.limit(0), *FILES).collect() == []
    assert align_tokens(docs.where("doc_id = 0 or doc_id = 1"), *FILES).count() == 2


def test_units_give_the_tokens_of_whole_texts():
    with_ = Aligner(*FILES)
    assert with_.by_unit
    signs = ["a", "b", "don", "'s", " ", "  ", "\n", "\t", " ", "7", ".", "é", "日", "<s>", "-", " ", "I"]
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choices(signs, k=rng.randint(1, 25)))
        each, whole = with_.align(with_.units(text)), with_.align([text])
        assert b";".join(each.groups) == whole.groups[0], text
        assert each.links.tolist() == whole.links.tolist(), text


def test_number_of_pairs_is_bounded_by_the_vocabularies(spark):
    with_ = Aligner(*FILES)
    bound = with_.most_pairs()
    assert bound < sum(map(len, with_.a_bytes)) + sum(map(len, with_.b_bytes))
    both = with_.align([t for r in duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null").fetchall() for t in with_.units(r[0])])
    for p in set(both.links.tolist()):
        a, b = with_.a_bytes[p >> 32], with_.b_bytes[p & 0xFFFFFFFF]
        assert a.endswith(b) or b.endswith(a)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    found = PerfectHash(np.concatenate([keys, keys[:3]]))
    assert sorted(found.index(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(np.arange(1000, dtype=np.uint64), keys)
    assert (found.index(others) == -1).all()


def test_tree_sum(spark):
    rows = spark.range(0, 10_000, 1, 200)

    def local(batches):
        total = np.zeros(37, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).to_numpy() % 37, minlength=37)
        return total

    assert tree_sum(rows, 37, np.int64, local).tolist() == np.bincount(np.arange(10_000) % 37).tolist()
    assert tree_sum(rows.where("id < 0"), 37, np.int64, local).tolist() == [0] * 37
    assert tree_sum(rows.where("id < 0"), 0, np.int64, lambda b: np.zeros(0)).tolist() == []
