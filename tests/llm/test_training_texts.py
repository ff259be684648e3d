"""Only copies with equal words are left out of the toxicity training counts, and every count is of the rows that stay."""

import math

import numpy as np

from tickloom.llm import toxicity


def test_word_sets_and_odds(spark):
    rng = np.random.default_rng(3)
    words = ["w" + "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 2)) for _ in range(60)]  # short: no word beginnings, much overlap
    rows, labels = [], []
    for i in range(400):
        some = sorted({words[j] for j in rng.integers(0, 60, 40)})
        rows.append((i, " ".join(some + (["scum"] if i % 4 == 0 else []))))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000 + k, rows[3][1].upper()) for k in range(300)]  # copies of one clean text
    labels += [(1000 + k, 0) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    texts = toxicity.training_texts(docs, given)
    want = {(frozenset(toxicity.fold(t).split()), k) for t, k in map(tuple, texts.collect())}
    assert toxicity._word_sets(texts).count() == len(want)
    n = [sum(k == x for _, k in want) for x in (0, 1)]
    lexicon = toxicity.learn_lexicon(docs, given)
    assert set(lexicon.words) == {"scum"}
    assert abs(lexicon.words["scum"] - (math.log((n[1] + 0.5) / (n[1] + 1)) - math.log(0.5 / (n[0] + 1)))) < 1e-9
