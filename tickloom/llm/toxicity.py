"""Operator 10: toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguises: compatibility forms and accents, letters of other scripts that look like Latin ones, digits and signs
between letters. The lexicon holds whole words and word beginnings with a weight each; weights and lexicon are learned from
labelled texts. A hit inside an exception phrase doesn't count. A text's rate is its summed weight per word, and a
logistic curve with two learned numbers turns the rate into a score.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import parts
from tickloom.session import stage

# Look-alikes of Latin letters, and digits that stand for letters.
_LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_SIGN = re.compile(r"[@$](?=[^\W\d_])|(?<=[^\W\d_])[!|](?=[^\W\d_])")
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
_MARKS = re.compile(r"[̀-ͯ​-‏⁠﻿­]+")
_DIGIT = re.compile(r"(?<=[^\W\d_])[013457]+|[013457]+(?=[^\W\d_])")
_ANY_DIGIT = re.compile("[013457]")
_WORD = re.compile(r"[^\W_]+")
_TABLE = str.maketrans(_LOOKALIKE)
_ANY_LOOKALIKE = re.compile(f"[{''.join(_LOOKALIKE)}]")

#: Phrases in which a listed word is harmless (folded, words with single spaces).
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clown car", "circus clown", "sore loser rule", "pond scum",
    "soap scum", "not stupid", "not an idiot", "the idiot by dostoevsky", "pathetic fallacy", "worthless check", "worthless stock",
)


def fold(text: str) -> str:
    """The words of ``text``, folded, with one space around each."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFKD", low))
        if _ANY_LOOKALIKE.search(low):
            low = low.translate(_TABLE)
    if "@" in low or "$" in low or "!" in low or "|" in low:
        low = _SIGN.sub(lambda m: _SIGNS[m[0]], low)
    if _ANY_DIGIT.search(low):
        low = _DIGIT.sub(lambda m: "".join(_LEET[c] for c in m[0]), low)
    return f" {' '.join(_WORD.findall(low))} "


@dataclass(frozen=True)
class Lexicon:
    """``words`` maps a folded word, or a word beginning with * at its end, to its weight; the score is 1 / (1 + exp(-(bias + slope * rate)))."""

    words: dict[str, float]
    bias: float = -4.0
    slope: float = 4.0
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for w, weight in self.words.items():
            found.add_word(f" {w[:-1]}" if w.endswith("*") else f" {w} ", (weight, len(w) + 1 - w.endswith("*")))
        for p in self.exceptions:
            found.add_word(f" {p} ", (None, len(p) + 1))
        found.make_automaton()
        return found


def rate_of(folded: str, automaton: ahocorasick.Automaton) -> float:
    """log(1 + 100 * summed weight per word) over hits outside exception phrases; 0 without hits or words.

    Of a word and word beginnings at one place the largest weight counts.
    """
    hits: dict[int, float] = {}
    spans: list[tuple[int, int]] = []
    for end, (weight, n) in automaton.iter(folded):
        end -= folded[end] == " "
        if weight is None:
            spans.append((end - n + 1, end))
        else:
            begin = end - n + 2
            hits[begin] = max(weight, hits.get(begin, 0.0))
    total = sum(w for at, w in hits.items() if not any(a < at <= b for a, b in spans)) if spans else sum(hits.values())
    return math.log1p(100 * total / max(10, folded.count(" ") - 1)) if total else 0.0


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no rest; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def training_texts(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents outside the held-out fifth, by the hash of their id.

    The cut is at a hash value taken from the number of labelled rows, so it neither sorts nor depends on the order of rows.
    """
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, given.count()))
    some = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(some, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def _word_sets(texts: DataFrame) -> DataFrame:
    """(toxic, features) of the distinct word sets with a label: words, and word beginnings of 4 to 8 letters. Texts with equal word sets count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in parts(whole, 0, 1 << 18)):
            out = {"words": [], "toxic": [], "features": []}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(fold(text).split())
                if words:
                    out["words"].append(hashlib.blake2b(" ".join(sorted(words)).encode(), digest_size=16).digest())
                    out["toxic"].append(toxic)
                    out["features"].append(sorted(words | {f"{w[:n]}*" for w in words for n in (4, 5, 6, 7, 8) if len(w) > n}))
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("words", pa.binary()), ("toxic", pa.int32()), ("features", pa.list_(pa.string()))])
    sets = texts.mapInArrow(run, "words binary, toxic int, features array<string>")
    return sets.groupBy("words", "toxic").agg(F.first("features").alias("features")).select("toxic", "features")


def learn_lexicon(docs: DataFrame, labels: DataFrame, rows: int = 20_000, size: int = 2000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon and its curve from at most ``rows`` labelled texts (see ``training_texts``).

    A word or word beginning is listed if at least 1 % of the toxic texts (3 or more) hold it, its smoothed log odds are over 2, and its toxic
    texts exceed what chance gives by a log likelihood of 10; of a beginning and a longer one, or a word, with 95 % of its toxic texts the
    longer one is listed. At most ``size`` entries, by support. All these counts are of distinct word sets: copies with equal words count once.
    Only counts of such entries and one pair of numbers per training text come to the driver. Without toxic or without
    other texts the lexicon is empty, and every score is that of the bias.
    """
    texts = stage(training_texts(docs, labels, rows))
    sets = stage(_word_sets(texts))
    n = {r["toxic"]: r["count"] for r in sets.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon({}, exceptions=exceptions)
    table = stage(sets.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")))
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (n[0] + 1))
    least = max(3, math.ceil(0.01 * n[1]))
    chance = F.col("bad") * F.log(F.col("bad") * (n[0] + n[1]) / (F.col("all") * n[1]))
    found = table.where(F.col("bad") >= least).withColumn("odds", odds).where((F.col("odds") > 2) & (chance >= 10)).orderBy(F.desc("bad"), "feature").limit(size).collect()
    kept: dict[str, float] = {}
    support = {r["feature"]: r["bad"] for r in found}
    for r in found:
        stem = r["feature"]
        if stem.endswith("*") and any(x != stem and x.startswith(stem[:-1]) and k >= 0.95 * r["bad"] for x, k in support.items()):
            continue
        kept[stem] = float(r["odds"])
    for w in [w for w in kept if any(x.endswith("*") and x != w and w.startswith(x[:-1]) for x in kept)]:
        del kept[w]
    lexicon = Lexicon(kept, exceptions=exceptions)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in (x for whole in batches for x in parts(whole, 0)):
            yield pa.RecordBatch.from_arrays([pa.array([rate_of(fold(t), automaton) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["rate", "toxic"])

    pairs = texts.mapInArrow(rates, "rate double, toxic int").groupBy("rate", "toxic").count().collect()  # at most about ``rows`` pairs
    bias, slope = _curve(*np.array(sorted(tuple(p) for p in pairs), float).T)
    return Lexicon(kept, bias, slope, exceptions)


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x, each pair counted ``n`` times, with a small penalty, by Newton steps."""
    w = np.zeros(2)
    a = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (p - y)) + 0.01 * w
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return round(float(w[0]), 6), round(float(w[1]), 6)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """``docs`` (with a column text) and a column ``name`` from 0 to 1; other columns stay as they are.

    A null or empty text, and one without hits, has the score of the rate 0. A column of ``docs`` with that name is replaced. An empty
    table gives no rows. Whole texts are read, one at a time.
    """
    bias, slope = lexicon.bias, lexicon.slope
    docs = docs.drop(name)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in (x for whole in batches for x in parts(whole, at)):
            rates = np.array([0.0 if t is None or not lexicon.words else rate_of(fold(t), automaton) for t in map(lambda x: x.as_py(), batch.column(at))])
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(bias + slope * rates, -500, 500))), pa.float64()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField(name, T.DoubleType())]))
