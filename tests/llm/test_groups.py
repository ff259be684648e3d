"""One row of each group of near copies stays, whatever the ids are."""

from tickloom.llm import jaccard
from tickloom.llm.stages import one_of_each_group

SPEC = jaccard.JaccardSpec(words=5, num=80, den=100)
WORDS = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefgh"}


def near(k):
    return WORDS[k] + " tail"


CASES = {
    "one id, unlinked texts": ([(1, WORDS["a"]), (1, WORDS["b"])], [{(1, WORDS["a"])}, {(1, WORDS["b"])}]),
    "an id that heads another group": ([(1, WORDS["a"]), (2, near("a")), (2, WORDS["b"])], [{(1, WORDS["a"])}, {(2, WORDS["b"])}]),
    "null ids beside a lone one": ([(1, WORDS["a"]), (None, near("a")), (None, WORDS["b"])], [{(1, WORDS["a"])}, {(None, WORDS["b"])}]),
    "near copies without ids": ([(None, WORDS["a"]), (None, near("a")), (None, near("a")), (3, WORDS["b"])], [{(None, WORDS["a"]), (None, near("a"))}, {(3, WORDS["b"])}]),
    "one id, near copies": ([(1, WORDS["a"]), (1, near("a")), (1, WORDS["a"]), (1, WORDS["a"].upper())], [{(1, WORDS["a"]), (1, near("a")), (1, WORDS["a"].upper())}]),
    "no words": ([(1, ""), (1, ""), (None, None), (2, WORDS["a"])], [{(1, "")}, {(1, "")}, {(None, None)}, {(2, WORDS["a"])}]),
}


def own(row, case):
    """``row`` with ids and words of its case alone."""
    i, text = row
    return (None if i is None else 100 * case + i, text and " ".join(f"case{case}{w}" if w.islower() else f"CASE{case}{w}" for w in text.split()))


def test_cases(spark):
    rows = [own(r, c) for c, (some, _) in enumerate(CASES.values()) for r in some]
    left = [{own(r, c) for r in g} for c, (_, groups) in enumerate(CASES.values()) for g in groups]
    kept = [tuple(r) for r in one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"), SPEC).collect()]
    assert len(kept) == len(left)
    for r in kept:
        left.remove(next(g for g in left if r in g))
