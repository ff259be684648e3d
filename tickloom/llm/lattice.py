"""Operator 12: the probability of a document under a unigram model of subword pieces, over all segmentations.

The pieces are those of an existing vocabulary. Its scores give the first weights (its scores are merge ranks, so a piece's prior falls with
its rank); expectation steps over the counted words of the training documents turn them into probabilities. A word, with one
space in front, is the end of a lattice of all its segmentations into pieces, and a forward recursion in log space adds up their probabilities. A document
is its words and an end.

Words are counted over the whole corpus and shuffled; each distinct word goes through the lattice once. Documents look up the
``heavy`` most frequent words in a table of that size which every task holds; all other words are joined by a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import parts
from tickloom.llm.dense import tree_sum
from tickloom.session import stage

#: distinct words that a task counts before it passes them on
COUNTED = 200_000
_TINY = -1e300


@dataclass(frozen=True)
class PieceModel:
    """``logs`` has the natural log of the probability of each piece (bytes, a leading space for a word's begin), ``end`` that of a document's end."""

    logs: dict[bytes, float]
    end: float

    @property
    def longest(self) -> int:
        return max(map(len, self.logs))

    def word(self, word: bytes) -> float:
        """The log of the summed probability of all segmentations of space+word."""
        return forward(b" " + word, self.logs, self.longest)[-1]


def forward(word: bytes, logs: dict[bytes, float], longest: int) -> list[float]:
    """For each prefix of ``word`` the log of the summed probability of its segmentations; -1e300 if it has none."""
    exp, log = math.exp, math.log
    alpha = [0.0]
    for j in range(1, len(word) + 1):
        best, terms = _TINY, []
        for i in range(max(0, j - longest), j):
            p = logs.get(word[i:j])
            if p is not None:
                p += alpha[i]
                terms.append(p)
                if p > best:
                    best = p
        alpha.append(best + log(sum([exp(t - best) for t in terms])) if best > _TINY else _TINY)
    return alpha


def expected(word: bytes, logs: dict[bytes, float], longest: int) -> tuple[float, dict[bytes, float]]:
    """The log probability of ``word``, and how often each piece is expected in its segmentations."""
    n = len(word)
    alpha = forward(word, logs, longest)
    if alpha[n] <= _TINY:
        return alpha[n], {}
    exp = math.exp
    share = [0.0] * n + [1.0]  # the probability, given the word, that a piece ends here
    found: dict[bytes, float] = {}
    for j in range(n, 0, -1):
        here = share[j]
        if here < 1e-12:
            continue
        for i in range(max(0, j - longest), j):
            piece = word[i:j]
            p = logs.get(piece)
            if p is not None and (x := here * exp(alpha[i] + p - alpha[j])) > 1e-12:
                found[piece] = found.get(piece, 0.0) + x
                share[i] += x
    return alpha[n], found


class Lattice:
    """``forward`` and ``expected`` for many words at once: words of one length go through a trie of the pieces together."""

    #: longer words are handled alone; characters of the words handled at once
    LONGEST, CHARS = 48, 1 << 17

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.logs, self.by_piece = logs, dict(zip(pieces, logs.tolist()))
        self.at = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        nodes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        number = {b"": 0} | {x: i for i, x in enumerate(sorted(nodes), 1)}
        keys = np.array([number[x[:-1]] << 8 | x[-1] for x in number if x], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.child = np.array([number[x] for x in number if x], np.int64)[order]
        self.piece = np.full(len(number), -1, np.int64)
        for p, i in self.at.items():
            self.piece[number[p]] = i

    def _together(self, words: list[bytes], uses: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
        """The log probability of each of ``words``, all of one length; adds the expected uses times ``times`` to ``uses``."""
        n, size = len(words), len(words[0])
        chars = np.frombuffer(b"".join(words), np.uint8).reshape(n, size).astype(np.int64)
        alpha = np.full((size + 1, n), _TINY)
        alpha[0] = 0.0
        edges: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        for i in range(size):
            rows, state = np.arange(n), np.zeros(n, np.int64)
            found = []
            for j in range(i, min(size, i + self.longest)):
                key = state << 8 | chars[rows, j]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[place] == key
                rows, state = rows[ok], self.child[place[ok]]
                if not len(rows):
                    break
                piece = self.piece[state]
                has = piece >= 0
                if has.any():
                    at, piece = rows[has], piece[has]
                    alpha[j + 1, at] = np.logaddexp(alpha[j + 1, at], alpha[i, at] + self.logs[piece])
                    if uses is not None:
                        found.append((j + 1, at, piece))
            edges.append(found)
        if uses is not None:
            share = np.zeros((size + 1, n))  # the probability, given the word, that a piece ends here
            share[size] = alpha[size] > _TINY
            for i in range(size - 1, -1, -1):
                for j, at, piece in edges[i]:
                    x = share[j, at] * np.exp(np.minimum(alpha[i, at] + self.logs[piece] - alpha[j, at], 0.0))
                    share[i, at] += x
                    uses += np.bincount(piece, x * times[at], len(uses))
        return alpha[size]

    def _groups(self, words: list[bytes]) -> Iterator[list[int]]:
        """Places of words of one length, so many that their characters fit; those too long one by one."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            size = len(words[order[at]])
            stop = at + 1
            while size <= self.LONGEST and stop < len(order) and len(words[order[stop]]) == size and (stop - at) * size < self.CHARS:
                stop += 1
            yield order[at:stop]
            at = stop

    def scores(self, words: list[bytes]) -> np.ndarray:
        """The log of the summed probability of all segmentations of each word."""
        out = np.empty(len(words))
        for some in self._groups(words):
            if len(words[some[0]]) > self.LONGEST:
                out[some[0]] = forward(words[some[0]], self.by_piece, self.longest)[-1]
            else:
                out[some] = self._together([words[k] for k in some])
        return out

    def add_uses(self, words: list[bytes], times: np.ndarray, uses: np.ndarray) -> None:
        """Adds the expected uses of every piece in each word, ``times`` as often."""
        for some in self._groups(words):
            if len(words[some[0]]) > self.LONGEST:
                for piece, x in expected(words[some[0]], self.by_piece, self.longest)[1].items():
                    uses[self.at[piece]] += times[some[0]] * x
            else:
                self._together([words[k] for k in some], uses, times[some])


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the rest ``fold``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces as bytes, and their prior probabilities: by rank of their scores (Zipf), byte pieces last. A byte string listed twice counts once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, single = [], []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            single.append(bytes([int(model.id_to_piece(i)[1:-1], 16)]))
        elif not model.is_control(i) and not model.is_unknown(i):
            plain.append((-model.get_score(i), model.id_to_piece(i).replace("▁", " ").encode()))
    pieces = list(dict.fromkeys([p for _, p in sorted(plain)] + [bytes([x]) for x in range(256)] + single))
    prior = 1.0 / (np.arange(len(pieces)) + 10.0)
    return pieces, prior / prior.sum()


def word_table(docs: DataFrame) -> DataFrame:
    """(word, c, n) of ``docs`` (text, held): how often each word occurs in the training texts and in all. Words are lower-cased (A-Z) runs of other than white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            train, held = seen
            words = list(train.keys() | held.keys())
            c = [train[w] for w in words]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array([k + held[w] for w, k in zip(words, c)], pa.int64())], ["word", "c", "n"])
            train.clear()
            held.clear()
            return out

        for batch in (x for whole in batches for x in parts(whole, "text")):
            for text, held in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("held").to_pylist()):
                if text:
                    seen[held].update(text.lower().split())
            if len(seen[0]) + len(seen[1]) > COUNTED:
                yield rows()
        yield rows()

    return docs.select("text", "held").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def learn_pieces(words: DataFrame, ends: int, path: str, rounds: int = 2, prior_tokens: float = 1000.0) -> PieceModel:
    """A model from counted training words (word, c) and ``ends`` documents, by ``rounds`` expectation steps.

    Each step adds up the expected uses of all pieces in all training words, each weighted by its count, with ``prior_tokens`` uses dealt by the prior, so
    every piece keeps some probability. The sums have the vocabulary's size. Without words the prior is the model.
    """
    pieces, prior = vocabulary(path)
    p = prior
    total = 0.0
    words = words.where("c > 0").select("word", "c")
    for _ in range(rounds):
        logs = np.log(p)

        def local(batches: Iterator[pa.RecordBatch], logs=logs) -> np.ndarray:
            lattice, uses = Lattice(pieces, logs), np.zeros(len(pieces))
            for batch in batches:
                lattice.add_uses([b" " + w for w in batch.column("word").to_pylist()], batch.column("c").to_numpy(), uses)
            return uses

        uses = tree_sum(words, len(pieces), np.float64, local)
        total = float(uses.sum())
        p = (uses + prior_tokens * prior) / (total + prior_tokens)
    # the end shares the mass with the pieces: one end per training document, and one more
    rest = total + prior_tokens + ends + 1
    return PieceModel(dict(zip(pieces, (np.log(p) + math.log((total + prior_tokens) / rest)).tolist())), math.log((ends + 1) / rest))


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The most frequent rows of (word, n), ``most`` of them or fewer: those from a bound of n on, found from a histogram of 16 cells per power of two."""
    cell = F.floor(16 * F.log2("n"))
    kept, low = 0, None
    for r in words.groupBy(cell.alias("cell")).count().orderBy(F.desc("cell")).collect():  # 1,024 rows at most
        if kept + r["count"] > most:
            break
        kept, low = kept + r["count"], r["cell"]
    return words.where(F.lit(False) if low is None else cell >= low)


def score_documents(docs: DataFrame, path: str, rounds: int = 2, heavy: int = 100_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Training documents are those for which ``held_out`` is false. A document's tokens are its words and one end. With c a token's count, N all and V the
    distinct training tokens, base_score is the sum of log10((c + 0.5) / (N + 0.5 * (V + 1))) over tokens; score is log10 of the document's
    probability under the pieces (see the module). n_known counts tokens with c > 0. A null or empty text is its end alone; rows that repeat
    are rows of their own and each counts; a null id is in training; other columns are left out. Whole texts are read. Without training
    documents N and V are 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held"))
    words = stage(word_table(docs))
    ends = docs.where(~F.col("held")).count()
    all_, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = all_ + ends, distinct + (ends > 0)
    model = learn_pieces(words, ends, path, rounds)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(list(model.logs), np.array(list(model.logs.values())))
        for batch in batches:
            scores = lattice.scores([b" " + w for w in batch.column("word").to_pylist()])
            yield batch.append_column("log", pa.array(scores / math.log(10), pa.float64()))

    weighed = stage(words.mapInArrow(weigh, "word binary, c long, n long, log double"))
    top = _frequent(weighed, heavy).select("word", "c", "log").toArrow()
    table = {w: (c, x) for w, c, x in zip(*(top.column(i).to_pylist() for i in range(3)))}
    base = n + 0.5 * (v + 1)
    known = {w: (c > 0, math.log10((c + 0.5) / base), x) for w, (c, x) in table.items()}
    end = (ends > 0, math.log10((ends + 0.5) / base), model.end / math.log(10))
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in (x for whole in batches for x in parts(whole, "text")):
            rows = []
            for doc_id, text, held in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("held").to_pylist()):
                words = text.lower().split() if text else []
                n_known, base_score, score = end
                rest: Counter[bytes] = Counter()
                for w, k in Counter(words).items():
                    if w in known:
                        is_known, b, x = known[w]
                        n_known += k * is_known
                        base_score += k * b
                        score += k * x
                    else:
                        rest[w] = k
                rows.append((doc_id, held, len(words) + 1, int(n_known), base_score, score, [{"word": w, "k": k} for w, k in rest.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))]
    scored = docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<struct<word: binary, k: long>>")
    first = stage(scored.withColumn("key", F.monotonically_increasing_id()))  # written once, so keys stay
    rare = first.select("key", F.explode("rest").alias("r")).select("key", "r.word", "r.k").join(weighed.select("word", "c", "log").hint("merge"), "word")
    k = F.col("k")
    added = rare.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, k).otherwise(0)).alias("more_known"), F.sum(k * F.log10((F.col("c") + 0.5) / F.lit(base))).alias("more_base"), F.sum(k * F.col("log")).alias("more"))
    out = first.drop("rest").join(added.hint("merge"), "key", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("more", zero)).alias("score"))
