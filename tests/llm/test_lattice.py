"""op12 against plain loops: base scores, expectation steps and the sum over all segmentations."""

import collections
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tickloom.llm import lattice, q_lattice

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def tokens(text):
    return [w.encode() for w in WORD.findall((text or "").translate(LOWER))] + [END]


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def splits(word):
    """All ways to cut ``word``."""
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:])]


def by_loops(rows, rounds):
    """(base score, score, known tokens, N) of each row; segmentations by a sum over suffixes in plain probabilities."""
    train = collections.Counter(t for i, text in rows if not is_held(i) for t in tokens(text))
    n, v = sum(train.values()), len(train)
    pieces, prior = lattice.vocabulary(PIECES)
    p = dict(zip(pieces, prior))
    longest = max(map(len, pieces))

    def suffixes(word):
        back = [0.0] * len(word) + [1.0]
        for i in range(len(word) - 1, -1, -1):
            back[i] = sum(p[word[i:j]] * back[j] for j in range(i + 1, min(len(word), i + longest) + 1) if word[i:j] in p)
        return back

    total = 0.0
    for _ in range(rounds):
        uses = collections.Counter()
        for w, c in train.items():
            if w is END:
                continue
            word = b" " + w
            back, front = suffixes(word), [1.0] + [0.0] * len(word)
            for j in range(1, len(word) + 1):
                front[j] = sum(front[i] * p[word[i:j]] for i in range(max(0, j - longest), j) if word[i:j] in p)
            for i in range(len(word)):
                for j in range(i + 1, min(len(word), i + longest) + 1):
                    if word[i:j] in p:
                        uses[word[i:j]] += c * front[i] * p[word[i:j]] * back[j] / back[0]
        total = sum(uses.values())
        p = {x: (uses[x] + 1000 * q) / (total + 1000) for x, q in zip(pieces, prior)}
    ends = train[END]
    rest = total + 1000 + ends + 1
    p = {x: q * (total + 1000) / rest for x, q in p.items()}
    out, known = [], {}
    for _, text in rows:
        words = tokens(text)
        for w in words[:-1]:
            if w not in known:
                known[w] = math.log10(suffixes(b" " + w)[0])
        out.append((len(words), sum(train[t] > 0 for t in words), n, sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in words), sum(known[w] for w in words[:-1]) + math.log10((ends + 1) / rest)))
    return out


def same(found, rows, want):
    assert len(found) == len(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found), key=key)
    want = sorted(((i, is_held(i), *w) for (i, _), w in zip(rows, want)), key=key)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-8)


def test_query_against_loops(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    same(q_lattice.op12_lattice_score(spark, SF).collect(), rows, by_loops(rows, 2))


@pytest.mark.parametrize("heavy", [0, 3, 100_000])
def test_odd_texts_null_ids_repeats_and_clashing_names(spark, heavy):
    texts = [None, "", " \t\n\x0b\x0c ", "a b a", "A B a", "ÀÉ à", "日本 語", "x" * 60, "the of the and " * 50, "new words here", "a b a", "nbsp\xa0in it", "🙂"]
    rows = [(None if i in (3, 9) else i, t) for i, t in enumerate(texts)] + [(10, "a b a"), (10, "a b a"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, c int, word string, log double").repartition(3)
    found = lattice.score_documents(docs, PIECES, heavy=heavy)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(found.collect(), rows, by_loops(rows, 2))


def test_empty_table_and_no_training_documents(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(200) if is_held(i)], "doc_id long, text string")
    assert lattice.score_documents(docs.limit(0), PIECES).collect() == []
    for r in lattice.score_documents(docs, PIECES).collect():
        assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["held_out"]) == (0, 0, 3, True)
        assert r["base_score"] == pytest.approx(3 * math.log10(0.5 / 0.5))
        assert math.isfinite(r["score"])


def test_forward_sums_all_segmentations_and_expected_uses():
    rng = np.random.default_rng(3)
    pieces = [b"a", b"b", b"ab", b"ba", b"aab", b" ", b" a", b" ab", b"bb"]
    for _ in range(50):
        p = dict(zip(pieces, rng.dirichlet(np.ones(len(pieces)))))
        logs = {x: math.log(q) for x, q in p.items()}
        word = b" " + bytes(rng.choice([97, 98], rng.integers(1, 11)).tolist())
        each = [(math.prod(p[x] for x in s), s) for s in splits(word) if all(x in p for x in s)]
        total = sum(q for q, _ in each)
        assert lattice.forward(word, logs, 3)[-1] == pytest.approx(math.log(total))
        uses = collections.Counter()
        for q, s in each:
            for x in s:
                uses[x] += q / total
        log, found = lattice.expected(word, logs, 3)
        assert log == pytest.approx(math.log(total))
        assert found == pytest.approx(dict(uses))
    assert lattice.expected(b"c", {b"a": -1.0}, 1) == (-1e300, {})


def test_many_words_at_once_equal_one_by_one():
    pieces, prior = lattice.vocabulary(PIECES)
    logs = np.log(prior)
    many = lattice.Lattice(pieces, logs)
    words = [b" " + t for _, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()[:40] for t in tokens(text)[:-1]]
    words += [b" ", b" " + "日本語".encode(), b" " + b"x" * 47, b" " + b"ab" * 100, b" \xff\x00"]
    each = [lattice.forward(w, many.by_piece, many.longest)[-1] for w in words]
    assert many.scores(words) == pytest.approx(each, rel=1e-12)
    uses, want = np.zeros(len(pieces)), np.zeros(len(pieces))
    times = np.arange(1, len(words) + 1)
    many.add_uses(words, times, uses)
    for w, k in zip(words, times):
        for piece, x in lattice.expected(w, many.by_piece, many.longest)[1].items():
            want[many.at[piece]] += k * x
    assert uses == pytest.approx(want, rel=1e-9, abs=1e-6)
    few = lattice.Lattice([b"a", b"ab"], np.log([0.5, 0.5]))
    assert few.scores([b"ab", b"b"]).tolist() == [pytest.approx(math.log(0.5)), -1e300]


def test_a_very_long_word_stays_finite():
    pieces, prior = lattice.vocabulary(PIECES)
    model = lattice.PieceModel(dict(zip(pieces, np.log(prior).tolist())), -5.0)
    long = model.word(b"ab" * 50_000)
    assert math.isfinite(long) and long < -10_000


def test_more_rounds_fit_the_training_words_better(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sums = [sum(r["score"] for r in lattice.score_documents(docs, PIECES, rounds=k).where("not held_out").collect()) for k in (0, 1, 3)]
    assert sums[0] < sums[1] < sums[2]
