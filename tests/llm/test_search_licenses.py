"""Top-k search and license scans against brute force."""

import collections
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import licenses, q_search, search

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bags(rows):
    return [(i, collections.Counter(WORD.findall((t or "").translate(LOWER)))) for i, t in rows]


def brute_top(docs, queries, k):
    docs = bags([r for r in docs if r[0] is not None])
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / max(1, len(docs))
    df = collections.Counter(w for _, c in docs for w in c)
    out = {}
    for q, words in bags(queries):
        scores = []
        for d, c in docs:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in words if w in c)
            if s > 0:
                scores.append((-round(s, 9), d))
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def same(got, want):
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.doc_id, r.score))
    assert {q for q in want if want[q]} == set(found)
    for q, rows in found.items():
        assert [s for _, s in rows] == pytest.approx([s for _, s in want[q]], abs=1e-6)
        for (d, s), (e, t) in zip(rows, want[q]):
            assert d == e or abs(s - t) < 1e-6


def test_top_k(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    same(q_search.op2_top_k_search(spark, SF).collect(), brute_top(docs, [r for r in docs if r[0] % 50 == 0], 10))


def test_top_k_shards_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(words[int(j)] for j in rng.zipf(1.3, int(rng.integers(1, 60))) % 300)) for i in range(900)]
    docs += [(1000, None), (1001, " \n"), (1002, "w1 w1"), (1003, "w1 w1"), (None, "w1 w2"), (1004, "only here")]
    queries = [(1, "w1 w5"), (2, "ONLY here"), (3, "nothing at all"), (4, None), (None, "w1"), (5, docs[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    same(search.top_k_search(df, asked, 7, shard=130).collect(), brute_top(docs, [q for q in queries if q[0] is not None], 7))
    assert search.top_k_search(df.limit(0), asked).count() == 0
    assert search.top_k_search(df, asked.limit(0)).count() == 0


def test_top_k_tasks_give_their_best_once(spark, monkeypatch):
    monkeypatch.setattr(search, "_DENSE", 40)
    monkeypatch.setattr(search, "_POSTINGS", 500)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[int(j)] for j in rng.zipf(1.2, int(rng.integers(1, 50))) % 400)) for i in range(1500)]
    docs += [(2000 + i, docs[3][1]) for i in range(30)]  # ties
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame([r for r in docs if r[0] % 50 == 0] + [(3, docs[3][1])], "query_id long, text string")
    n = asked.count()
    rows = search._best_of_tasks(df, asked, 5, 1.2, 0.75, shard=40, groups=2, chunk=10)
    assert rows.rdd.getNumPartitions() >= 2 * -(-n // 10)
    assert rows.count() <= 2 * 5 * n
    found = search.top_k_search(df, asked, 5, shard=40, groups=2, chunk=10).collect()
    same(found, brute_top(docs, [r for r in docs if r[0] % 50 == 0] + [(3, docs[3][1])], 5))
    assert sorted((r["rank"], r.doc_id) for r in found if r.query_id == 3) == list(enumerate([3, 2000, 2001, 2002, 2003], 1))


def test_top_k_scores_few_documents(monkeypatch):
    """Only documents that may be among the best are scored, though scores differ by less than single precision tells."""
    monkeypatch.setattr(search, "_DENSE", 30)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(600)]
    docs = [(i, " ".join(words[int(j)] for j in rng.zipf(1.2, int(rng.integers(1, 80))) % 600)) for i in range(3000)]
    docs += [(4000 + i, docs[50][1] + " w1" * (20_000 + i)) for i in range(20)]  # all but equal
    docs += [(5000 + i, docs[100][1]) for i in range(15)]  # ties
    asked = [r for r in docs if r[0] % 50 == 0]
    n, mean = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    df = collections.Counter(w for _, t in docs for w in set(t.split()))
    scored = 0

    def hashes(text):
        return next(search._bags(pa.array([text])))

    code = {w: hashes(w)[0][0] for w in df}
    common = np.sort(np.array([code[w] for w, _ in df.most_common(30)], np.uint64))
    weight = {code[w]: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    bags_asked = [hashes(t)[0] for _, t in asked]
    sizes, terms = np.array([len(x) for x in bags_asked]), np.concatenate(bags_asked)
    scores, ids = np.zeros((len(asked), 10)), np.zeros((len(asked), 10), np.int64)
    whole = search._Shard._scores

    def counted(self, q, *rest):
        nonlocal scored
        scored += len(q)
        return whole(self, q, *rest)

    monkeypatch.setattr(search._Shard, "_scores", counted)
    for a in range(0, n, 1000):
        shard = search._Shard([i for i, _ in docs[a:a + 1000]], [hashes(t) for _, t in docs[a:a + 1000]], mean, 1.2, 0.75, common)
        scores, ids = shard.best(sizes, terms, np.array([weight[t] for t in terms]), scores, ids)
    want = brute_top(docs, asked, 10)
    for (q, _), values, names in zip(asked, scores, ids):
        assert [(d, pytest.approx(s, abs=2e-9)) for d, s in want[q]] == [(d, s) for d, s in zip(names.tolist(), values.tolist()) if s > 0]
    assert scored < 0.1 * n * len(asked)


def brute_licenses(text, words=5):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [tuple(w[i:i + words]) for i in range(len(w) - words + 1)]
    out = {}
    for i, (name, template) in enumerate(licenses.TEMPLATES):
        t = WORD.findall(template.translate(LOWER))
        t = {tuple(t[j:j + words]) for j in range(len(t) - words + 1)}
        for at in range(0, len(runs), len(t)):
            found = len(t & set(runs[at:at + 2 * len(t)]))
            if 10 * found >= 8 * len(t):
                a = out.setdefault(i, [0, at, 0])
                a[0], a[2] = max(a[0], found), a[2] + 1
    return {(licenses.TEMPLATES[i][0], i, f, at, n) for i, (f, at, n) in out.items()}


def test_licenses(spark):
    long = licenses.TEMPLATES[1][1]
    filler = " ".join(f"x{i}" for i in range(777))
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    docs += [(5000, f"{filler} {long} {filler}"), (5001, long.replace("free of charge", "free of cost")), (5002, " ".join(long.split()[:20])), (5003, None), (5004, ""), (5005, "mit license"), (5006, (filler + " ") * 30 + long.upper())]
    got = collections.defaultdict(set)
    for r in licenses.scan_licenses(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")).collect():
        got[r.doc_id].add((r.license, r.template, r.found, r.first_word, r.windows))
    want = {i: x for i, t in docs if (x := brute_licenses(t))}
    assert got == want and {5000, 5001, 5006} <= set(got) and 5002 not in got


def test_license_query(spark):
    got = collections.Counter(r.doc_id for r in q_search.op6_license_scan(spark, SF).collect())
    assert got == collections.Counter({i: len(x) for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall() if (x := brute_licenses(t))})
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
