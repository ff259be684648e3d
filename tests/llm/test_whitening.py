"""op13 against exact sums and eigenvectors of another solver."""

from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tickloom.llm import q_whitening
from tickloom.llm.eigen import refined_eigen
from tickloom.llm.whitening import whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


def by_loops(rows, top=4):
    """{position: (deviation, [whitened up to sign], [explained])}, n; rows as (vec_id, vector)."""
    kept = [(k, [int(np.floor(256.0 * float(c))) for c in v]) for k, (_, v) in enumerate(rows) if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(c - m) for c, m in zip(x, mean)] for x in fit])
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:top], w[:, ::-1][:, :top]
    out = {}
    for k, x in kept:
        y = np.array([float(c - m) for c, m in zip(x, mean)])
        out[k] = (sum((n * c - s) ** 2 for c, s in zip(x, sums)), y @ w / np.sqrt(e), e / np.trace(v))
    return out, n


def test_query_against_loops(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    want, n = by_loops(rows)
    found = q_whitening.op13_whiten(spark, SF).orderBy("vec_id", "component").collect()
    assert len(found) == 4 * len(want)
    table = np.array([r["whitened"] for r in found]).reshape(-1, 4)
    loops = np.array([want[k][1] for k in range(len(rows))])
    signs = np.sign((table * loops).sum(0))
    assert np.abs(table - loops * signs).max() < 1e-9
    for r in found:
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, want[r["vec_id"]][0])
        assert r["explained"] == pytest.approx(want[r["vec_id"]][2][k], rel=1e-12)
        assert 0 <= r["identity_error"] < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = [(i, [float(c) for c in rng.normal(0, 1, 6)]) for i in range(40)]
    odd = [(100, None), (101, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (104, [0.0, 1.0]), (105, []), (None, base[0][1]), (3, base[3][1]), (7, base[8][1]), (106, [-0.0] * 6)]
    rows = base + odd
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)
    rows = [(i, None if v is not None and len(v) != 6 else v and [np.float32(c) if c is not None else None for c in v]) for i, v in rows]
    want, n = by_loops(rows)
    found = whiten(table).collect()
    assert len(found) == 4 * len(want)
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"], r["n"], r["deviation"], abs(r["whitened"])) for r in found)
    plain = sorted((rows[k][0] is None, rows[k][0] or 0, c + 1, n, d, abs(float(w[c]))) for k, (d, w, _) in want.items() for c in range(4))
    assert [g[:5] for g in got] == [p[:5] for p in plain]
    assert [g[5] for g in got] == pytest.approx([p[5] for p in plain], abs=1e-9)
    assert whiten(table.limit(0)).collect() == []
    assert whiten(table.where("vec_id = 105")).collect() == []


def test_few_dimensions_equal_vectors_and_large_values(spark):
    two = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(4)], "vec_id long, embedding array<double>")
    found = whiten(two).orderBy("vec_id", "component").collect()
    assert [r["component"] for r in found] == [1, 2] * 4
    assert [r["whitened"] is None for r in found] == [False, True] * 4  # the second entry never varies
    assert found[0]["explained"] == pytest.approx(1.0)
    same = whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, None)}
    large = [(i, [1e5 * i, 2.5e6 - i]) for i in range(6)]
    want, _ = by_loops(large, 2)
    for r in whiten(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect():
        assert r["deviation"] == want[r["vec_id"]][0]
    with pytest.raises(Exception, match="(?i)overflow|too (large|big)"):
        whiten(spark.createDataFrame([(i, [1e9 * i]) for i in range(6)], "vec_id long, embedding array<double>")).collect()


def with_values(e, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(e), len(e))))
    return (q * e) @ q.T, q


@pytest.mark.parametrize("values", [np.arange(1, 33.0), 2.0 ** -np.arange(20.0), np.r_[5, 5 + 1e-6, 5 + 2e-6, np.arange(1, 5.0)], np.r_[3 + 1e-9 * np.arange(6), 1.0, 2.0], np.r_[2.0, 2.0, 2.0, 1.0, 0.0, 0.0], np.r_[-1.0, 4.0, 4 + 1e-8]])
def test_refined_eigenvectors(values):
    a, _ = with_values(values)
    a = (a + a.T) / 2
    e, x = refined_eigen(a)
    size = np.abs(values).max()
    assert np.abs(e - np.sort(np.linalg.eigvalsh(a))[::-1]).max() < 1e-14 * size * len(values)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14 * len(a)
    assert np.abs(a @ x - x * e).max() < 2e-15 * size * len(a)


def test_float32_alone_is_far_from_double_and_zero_matrices_have_a_basis():
    a, _ = with_values(np.arange(1, 33.0))
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(a @ rough - rough * np.arange(1, 33.0)).max() > 1e-7
    e, x = refined_eigen(np.zeros((3, 3)))
    assert e.tolist() == [0, 0, 0] and (x == np.eye(3)).all()
