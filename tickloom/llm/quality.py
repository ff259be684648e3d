"""Operator 3: document quality rules as a short-circuit cascade. DataFrame functions only.

Words are runs of characters other than space and 0x09-0x0D. A null text counts as empty. Every feature is an
expression over the whole text; no row leaves its task. The rules are the branches of one CASE expression, which
evaluates a branch only for rows that all earlier ones let pass. Their order comes from a bounded sample:
rejections per cost, each rule counted on the sample rows that the rules before it let pass.
The verdict doesn't depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import stage

_BLANK = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a document that the rule turns down; it may use text, words and the base counts."""

    name: str
    rejects: Callable[[], Column]


def _lines() -> Column:
    return F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, _BLANK, "")) > 0)


#: Production thresholds, as whole-number shares so that every engine agrees.
RULES = (
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("duplicate lines", lambda: 100 * F.col("n_dup_lines") > 40 * F.size(_lines())),
    Rule("word length", lambda: (F.col("word_chars") > 12 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))),
    Rule("few distinct words", lambda: 100 * F.size(F.array_distinct("words")) < 10 * F.least(F.col("n_words"), F.lit(1000))),
    Rule("capitals", lambda: 100 * (F.col("word_chars") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BLANK, ""))) > 30 * F.col("word_chars")),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a filter above makes Spark move the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are compared by a 64-bit hash; without two equal hashes nothing is sorted."""
    def hashes(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def repeated(s: Column) -> Column:
        found = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(_let(pairs, repeated))).otherwise(0)

    return _let(words, lambda w: _let(hashes(w), count)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc_id, text, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed); other columns are left out."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = text.withColumn("words", F.array_remove(F.split("text", _SPACES), ""))
    counts = words.select(
        "doc_id", "text", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _BLANK, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(_lines(), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, fraction: float = 0.05, seed: int = 7) -> list[Rule]:
    """The rules by rejections per cost on at most ``sample_rows`` rows of a ``fraction`` sample.

    The cost of a rule is its time over the sample less that of a plain pass. With an empty sample, or with rules that reject
    nothing, the cheaper rule goes first.
    """
    sample = stage(base_counts(docs.select("doc_id", "text").sample(fraction, seed).limit(sample_rows)).where("not base_failed"))

    def seconds(*rejects: Column) -> float:
        start = time.perf_counter()
        sample.agg(F.count("text"), F.sum(F.size("words")), F.sum("word_chars"), *(F.sum(F.coalesce(x, F.lit(False)).cast("int")) for x in rejects)).collect()
        return time.perf_counter() - start

    seconds()
    plain = min(seconds() for _ in range(2))
    cost = {r.name: max(1e-4, min(seconds(r.rejects()) for _ in range(2)) - plain) for r in rules}
    flags = sample.select(*(F.coalesce(r.rejects(), F.lit(False)).alias(str(i)) for i, r in enumerate(rules))).collect()  # at most sample_rows rows
    left, order = dict(enumerate(rules)), []
    while left:
        def gain(i: int) -> tuple[float, float]:
            return sum(f[str(i)] for f in flags) / cost[rules[i].name], -cost[rules[i].name]

        best = max(left, key=gain)
        flags = [f for f in flags if not f[str(best)]]
        order.append(left.pop(best))
    return order


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Base counts of every row of ``docs``, base_failed, kept, and the rule that turned the row down (rejected_by).

    ``rules`` is the order of evaluation, by default that of ``cascade_order``. A row that fails the base is not
    tried against the rules. Every row gives one row: null ids, repeated rows and empty texts (0 words: base_failed)
    included; an empty table gives none.
    """
    ordered = cascade_order(docs) if rules is None else rules
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in ordered:
        verdict = verdict.when(rule.rejects(), F.lit(rule.name))
    return base_counts(docs).withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull()).drop("words")
