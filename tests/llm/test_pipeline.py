"""The corpus pipeline stage by stage against plain loops, on a small fixture with planted cases."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from test_operators import brute_components, brute_secrets, brute_targets, check_pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
BAD = "idiot moron scum".split()


def fixture_rows():
    rng = np.random.default_rng(5)
    vocabulary = ["w" + "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 5)) for _ in range(3000)]
    rows, labels = [], []
    for i in range(240):
        words = [vocabulary[j] for j in rng.integers(0, 3000, int(rng.integers(30, 120)))]
        toxic = i % 6 == 0
        if toxic:
            for k in range(0, len(words), 9):
                words[k] = BAD[(i + k) % 3]
        rows.append((i, " ".join(words), "en", f"src{i % 5}"))
        labels.append((i, 1, int(toxic)))
    rows[7] = (7, rows[7][1] + ' token = "0cab398dc11d1a2a11dc6572c8df8bd228c864f3" end', "en", "src2")
    clean = [r for r in rows if r[0] % 6]
    rows += [(1000 + k, clean[k][1], "en", None) for k in range(10)]  # exact copies
    rows += [(1100 + k, clean[20 + k][1] + " tail", "en", "src1") for k in range(10)]  # near copies
    rows += [(1200, None, None, None), (1201, "", "en", "src1"), (1202, "\n \t", None, "src1"), (None, "alone without an id", "en", "src3"), (1203, clean[50][1], "en", "src0"), (1203, clean[50][1], "en", "src0")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows], labels


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    rows, labels = fixture_rows()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], str(folder)).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return str(folder), [[tuple(r) for r in df.collect()] for df in out], [df.schema.simpleString() for df in out]


def test_columns(results):
    _, _, schemas = results
    assert len(set(schemas[:5])) == 1


def test_toxicity(results):
    _, (docs, kept, *_), _ = results
    want = [r for r in docs if not (r[0] is not None and r[0] < 240 and r[0] % 6 == 0)]
    assert collections.Counter(kept) == collections.Counter(want)


def test_near_duplicates(results):
    _, (_, docs, kept, *_), _ = results
    component = dict()
    for i, n, c in brute_components([(r[0], r[1]) for r in docs], 5, 80):
        component[i] = (n, c)
    want = {r for r in docs if r[0] is None or component[r[0]][0] == 0 or component[r[0]][1] == r[0]}
    assert len(kept) == len(set(kept)) and set(kept) == want
    assert not {1000, 1100} & {r[0] for r in kept}


def test_secrets(results):
    _, (_, _, docs, kept, *_), _ = results
    before, after = ({r[0]: r for r in rows} for rows in (docs, kept))
    assert set(before) == set(after)
    assert [i for i in before if before[i] != after[i]] == [7]
    text = before[7][1]
    (_, s, e) = brute_secrets(text)[0]
    assert after[7][1] == text[:s] + "[SECRET]" + text[brute_secrets(text)[-1][2]:] and after[7][4] == len(after[7][1])


def test_mixing(results):
    _, (_, _, _, docs, kept, _), _ = results
    def words(text):
        return WORD.findall(text or "")

    size = collections.Counter()
    for r in docs:
        size[r[3]] += len(words(r[1]))
    target = brute_targets({s: n for s, n in size.items()})
    got = collections.Counter()
    for r in kept:
        got[r[3]] += len(words(r[1]))
    assert all(abs(got[s] - target[s]) <= 0.5 for s in size)
    texts = {r[0]: r[1] for r in docs}
    cut = [r for r in kept if r[1] != texts[r[0]]]
    assert all(texts[r[0]].startswith(r[1]) and r[4] == len(r[1]) for r in cut) and len(cut) <= len(size)
    assert max(collections.Counter(r[0] for r in kept).values()) <= 3


def test_packing(results):
    _, (*_, docs, pieces), _ = results
    P = collections.namedtuple("P", "doc_id start length ids_crc32 doc_tokens sequence_id offset")
    check_pieces([r[1] for r in docs], [P(*p) for p in pieces])


def test_run(spark, results):
    folder, stages, _ = results
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()), key=repr) == sorted((p[:5] for p in stages[-1]), key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
