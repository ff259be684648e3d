"""Alignment reads and aligns each text once; links are written packed."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import alignment

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_texts_are_aligned_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i} and more of them") for i in range(40)], "doc_id long, text string").repartition(2)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    args = FILES
    rows = alignment.align_tokens(docs.withColumn("text", seen.asNondeterministic()("text")), *args).collect()
    assert len(rows) == 40 and read.value == 40
    assert all(r.groups and r.n_links == r.n_groups == r.groups.count(b";") + 1 for r in rows)
    pairs = {}
    for r in rows:
        for g in bytes(r.groups).decode().split(";"):
            a, b = (x.split(",")[-1] for x in g.split("|"))
            pairs[a, b] = pairs.get((a, b), 0) + 1
    assert sum(r.count_sum for r in rows) == sum(n * n for n in pairs.values())


@pytest.mark.parametrize("narrow", [True, False])
def test_packed_links(narrow):
    links = np.array([5 << 32 | 7, 65535 << 32 | 65535, 0, 50_000 << 32 | 31_999], np.int64)
    n = np.array([3, 0, 1])
    column = pa.array([alignment._packed(links[:3], narrow), b"", alignment._packed(links[3:], narrow)], pa.binary())
    assert alignment._links(column, n).tolist() == links.tolist() and alignment._links(column[:0], n[:0]).tolist() == []


def test_known_units_are_kept_in_arrow_arrays_and_forgotten():
    with_ = alignment.aligner(*FILES)
    known = alignment._Known(with_)
    units = [f"unit{i}" for i in range(2000)] + ["x" * 100]
    for some in (units[:700], units[700:]):
        known.add(some)
    want = with_.align(units)
    assert known.groups.to_pylist() == want.groups and known.numbers.T.tolist() == np.stack([want.n_a, want.n_b, want.n_links, ~want.good], 1).tolist()
    assert isinstance(known.groups, pa.Array) and known.links.nbytes + known.groups.nbytes + known.numbers.nbytes < 100 * len(units)
    known.uses[:] = 2
    known.uses[:10] = 1
    known.forget()
    assert list(known.table) == units[10:-1] and known.groups.to_pylist() == want.groups[10:-1]
    assert alignment._links(pa.array([x.values.to_numpy().tobytes() for x in known.links], pa.binary()), known.numbers[2]).tolist() == want.links[want.n_links[:10].sum():len(want.links) - want.n_links[-1]].tolist()
