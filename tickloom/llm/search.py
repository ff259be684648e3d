"""Operator 2: exact BM25 top-k search with block-max pruning per shard and an exact merge.

Document frequencies and the mean length come from all documents and give each query term its weight. A shard is a run of at most
``shard`` documents of a task, in blocks of 64 by length: its inverted index lives in the task that reads them. Queries are streamed past each shard, many at once.
The postings of the terms in most documents are a dense matrix by document, the others lists by term. The lists of a query's terms are summed for
all documents; a block is opened only if the most of these sums and of the block's largest dense contributions together reach the k-th score found so far. In
opened blocks the dense part of many queries is a matrix product in single precision; the documents that this leaves among the best, ties and rounding errors
allowed for, are scored with all digits.
A task keeps the best k of each query over all its shards and gives them once. Documents are dealt to a fixed number of groups and queries to chunks of
a fixed size; there is a task for each group and chunk, so rows made grow with the queries, not with the shards. The
best k of these, by score and then by id, are exact because the weights are the same in all shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import slices
from tickloom.llm.shingles import word_hashes
from tickloom.llm.warc import _files
from tickloom.session import shared_dir

_BLOCK = 64
#: terms with dense columns
_DENSE = 512
#: postings that are gathered at once, but for those of a single query
_POSTINGS = 1 << 17
#: sums of ``_DENSE`` terms in single precision, none below 0, are off by less than half of what this factor takes away
_LESS = 1 - 1e-3


def _bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct word hashes, their counts) of each text."""
    for a, b in slices(column):
        hashes, bounds = word_hashes(column.slice(a, b - a))
        for i, j in zip(bounds[:-1], bounds[1:]):
            yield np.unique(hashes[i:j], return_counts=True)


class _Shard:
    """Inverted index of some documents, by length, with the largest contribution of each of the ``common`` terms, sorted, in each block.

    Postings of the common terms are dense columns in single precision, to find documents that may be among the best, and lists by document, to score these.
    """

    def __init__(self, ids: list, bags: list[tuple[np.ndarray, np.ndarray]], mean: float, k1: float, b: float, common: np.ndarray):
        length = np.array([c.sum() for _, c in bags], float)
        order = np.argsort(length, kind="stable")  # blocks of like lengths have closer bounds
        bags, length = [bags[i] for i in order.tolist()], length[order]
        self.ids, self.common = np.array(ids, np.int64)[order], common
        self.blocks = -(-len(ids) // _BLOCK)
        doc = np.repeat(np.arange(len(bags)), [len(t) for t, _ in bags])
        count = np.concatenate([c for _, c in bags]).astype(float) if bags else np.zeros(0)
        term = np.concatenate([t for t, _ in bags]) if bags else np.zeros(0, np.uint64)
        value = count * (k1 + 1) / (count + k1 * (1 - b + b * (length / mean)[doc])) if len(doc) else count
        column, often = _places(common, term)
        self.column, self.heavy = column[often], value[often]
        self.begin = np.searchsorted(doc[often], np.arange(len(bags) + 1))
        self.dense = np.zeros((self.blocks * _BLOCK, len(common)), np.float32)
        self.dense[doc[often], self.column] = self.heavy
        self.dense_most = self.dense.reshape(self.blocks, _BLOCK, -1).max(1) if self.blocks else np.zeros((0, len(common)), np.float32)
        doc, value, term = doc[~often], value[~often], term[~often]
        order = np.argsort(term, kind="stable")
        self.doc, self.value = doc[order], value[order]
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))

    def _rare(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The sums of the weighted values of other terms than common ones, for each query and document; some postings are gathered at once."""
        at, known = _places(self.terms, terms)
        row, at, weights = np.repeat(np.arange(len(sizes)), sizes)[known], at[known], weights[known]
        first, count = self.first[at], (self.last - self.first)[at]
        begin = np.searchsorted(row, np.arange(len(sizes) + 1))
        done = np.append(0, np.cumsum(count))[begin]
        width = len(self.dense)
        out = np.empty((len(sizes), width))
        a = 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(done, done[a] + _POSTINGS, side="right")) - 1)
            some = slice(begin[a], begin[b])
            n = count[some]
            place = np.repeat(first[some] - (np.cumsum(n) - n), n)
            place += np.arange(len(place))
            value = np.repeat(weights[some], n)
            value *= self.value.take(place, mode="clip")  # the quickest way; no place is outside
            place = self.doc.take(place, mode="clip")
            place += np.repeat((row[some] - a) * width, n)
            out[a:b] = np.bincount(place, value, (b - a) * width).reshape(b - a, width)
            a = b
        return out

    def _near(self, opened: np.ndarray, rare: np.ndarray, light: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, queries that opened it, their scores of its documents up to single precision) of all opened blocks."""
        for i in np.flatnonzero(opened.any(0)).tolist():
            asked, some = np.flatnonzero(opened[:, i]), slice(i * _BLOCK, (i + 1) * _BLOCK)
            yield i, asked, light[asked] @ self.dense[some].T + rare[asked, some]

    def _scores(self, q: np.ndarray, d: np.ndarray, rare: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of pairs of a query and a document, with all digits; ``weights`` of the common terms by query."""
        score = np.empty(len(q))
        for a in range(0, len(q), 1 << 12):
            owner, pair = d[a:a + (1 << 12)], q[a:a + (1 << 12)]
            n = self.begin[owner + 1] - self.begin[owner]
            at = np.repeat(self.begin[owner] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            sums = np.bincount(np.repeat(np.arange(len(owner)), n), weights[np.repeat(pair, n), self.column[at]] * self.heavy[at], len(owner))
            score[a:a + (1 << 12)] = np.round(sums + rare[pair, owner], 9)
        return score

    def best(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of each query, from those found before (unused places have score 0) and the documents of this shard.

        ``sizes``: how many of the terms and weights each query has. Only scores over 0 count; equal scores are by id.
        """
        n, k = scores.shape
        row = np.repeat(np.arange(n), sizes)
        column, often = _places(self.common, terms)
        heavy = np.zeros((n, len(self.common)))
        heavy[row[often], column[often]] = weights[often]
        light = heavy.astype(np.float32)
        rare = self._rare(np.bincount(row[~often], minlength=n), terms[~often], weights[~often])
        width = len(self.dense)
        bound = rare.reshape(n, self.blocks, _BLOCK).max(2) + light @ self.dense_most.T
        least = _LESS * scores[:, -1] - 1e-8
        fresh = np.flatnonzero(scores[:, -1] == 0)
        if len(fresh) and self.blocks >= k:  # the best documents of k blocks: the k-th score is not below the last of these
            most = np.zeros((len(fresh), self.blocks))
            for i, asked, near in self._near(bound[fresh] > 0, rare[fresh], light[fresh]):
                most[asked, i] = near.max(1)
            least[fresh] = _LESS * np.partition(most, -k, axis=1)[:, -k] - 1e-8
        least = np.maximum(least, 0)[:, None]
        hits = [(asked[x], y + i * _BLOCK, near[x, y]) for i, asked, near in self._near(bound > _LESS * least, rare, light) for x, y in [np.nonzero(near > least[asked])]]
        if not hits:
            return scores, ids
        q, d, near = (np.concatenate(x) for x in zip(*hits))
        order = np.lexsort((-near, q))
        q, d, near = q[order], d[order], near[order]
        last = np.searchsorted(q, q) + k - 1  # the place of the k-th of the query's documents
        some = (last >= np.searchsorted(q, q, side="right")) | (near >= _LESS * near[np.minimum(last, len(q) - 1)] - 1e-8)
        q, d = q[some], d[some]
        old = np.nonzero(scores > 0)
        owner, values, names = np.append(old[0], q), np.append(scores[old], self._scores(q, d, rare, heavy)), np.append(ids[old], self.ids[d])
        order = np.lexsort((names, -values, owner))
        owner, values, names = owner[order], values[order], names[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < k
        scores, ids = np.zeros_like(scores), np.zeros_like(ids)
        scores[owner[kept], place[kept]], ids[owner[kept], place[kept]] = values[kept], names[kept]
        return scores, ids


def _places(sorted_terms: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each term among sorted ones, and whether it is there."""
    if not len(sorted_terms):
        return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
    at = np.minimum(np.searchsorted(sorted_terms, terms), len(sorted_terms) - 1)
    return at, sorted_terms[at] == terms


def top_k_search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, shard: int = 4096, groups: int = 16, chunk: int = 65_536) -> DataFrame:
    """(query_id, doc_id, score, rank) of the ``k`` best documents for each query by BM25, from 1 on; equal scores by doc_id.

    docs: (doc_id, text), queries: (query_id, text), both with ids; rows with null ids are left out, texts without words match nothing. Words are
    runs of characters other than space and 0x09-0x0D, A-Z as a-z; a query is the set of its words. A repeated doc_id
    counts as a document of its own; a repeated query_id is one query with the words of all its rows. Scores are rounded to 9 digits within a shard.
    Documents are read in at most ``groups`` tasks for every about ``chunk`` queries.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return _best_of_tasks(docs, queries, k, k1, b, shard, groups, chunk).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best_of_tasks(docs: DataFrame, queries: DataFrame, k: int, k1: float, b: float, shard: int, groups: int, chunk: int) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` best documents of each task for each of its queries."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")).where("query_id is not null")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = list(_bags(batch.column(1)))
            terms, n = np.unique(np.concatenate([t for t, _ in bags]), return_counts=True) if bags else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            words = sum(int(c.sum()) for _, c in bags)
            yield pa.RecordBatch.from_pydict({"term": [None, *terms.view(np.int64).tolist()], "df": [len(bags), *n.tolist()], "words": [words] + [0] * len(n)}, schema=counted)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [t.view(np.int64) for t, _ in _bags(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.list_(pa.int64()))], ["query_id", "terms"])

    counted = pa.schema([("term", pa.int64()), ("df", pa.int64()), ("words", pa.int64())])
    table = docs.mapInArrow(frequency, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    asked = queries.mapInArrow(terms_of, "query_id long, terms array<long>").select("query_id", F.explode("terms").alias("term")).distinct()
    folder = shared_dir(spark)
    table.write.parquet(f"{folder}/terms")
    table = spark.read.parquet(f"{folder}/terms")
    total = table.where("term is null").first()
    n, mean = (total["df"], max(1e-9, total["words"] / total["df"])) if total and total["df"] else (0, 1.0)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(table.where("term is not null").select("term", "df"), "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("w")))).alias("x"))  # a query's own words
    weighed.select("query_id", "x.term", "x.w").write.option("maxRecordsPerFile", chunk).parquet(f"{folder}/queries")
    sizes = spark.read.parquet(f"{folder}/queries").groupBy(F.col("_metadata.file_path").alias("path")).count().orderBy("path").collect() if n else []
    chunks: list[list[str]] = []
    size = 0
    for path, some in sizes:
        if not chunks or size + some > chunk:
            chunks.append([])
            size = 0
        chunks[-1].append(path)
        size += some
    often = table.where("term is not null and df > 1").orderBy(F.desc("df"), "term").limit(_DENSE).select("term").collect() if chunks else []
    common = np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64))

    def asked_in(paths: list[str]) -> Iterator[pa.RecordBatch]:
        for path in paths:
            files, name = _files(path)
            with files.open_input_file(name) as f:
                yield from pq.ParquetFile(f).iter_batches(256)

    def answers(paths: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = []  # for each batch of queries

        def add(ids: list[int], bags: list[tuple[np.ndarray, np.ndarray]]) -> None:
            index = _Shard(ids, bags, mean, k1, b, common)
            for i, part in enumerate(asked_in(paths)):
                if i == len(best):
                    best.append((np.zeros((len(part), k)), np.zeros((len(part), k), np.int64)))
                terms, weights = part.column("term"), part.column("w")
                best[i] = index.best(terms.value_lengths().to_numpy(), terms.flatten().to_numpy().view(np.uint64), weights.flatten().to_numpy(), *best[i])

        ids: list[int] = []
        bags: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i, bag in zip(batch.column(0).to_pylist(), _bags(batch.column(1))):
                ids.append(i)
                bags.append(bag)
                if len(ids) == shard:
                    add(ids, bags)
                    ids, bags = [], []
        if ids:
            add(ids, bags)
        for part, (scores, names) in zip(asked_in(paths) if best else (), best):
            row, place = np.nonzero(scores > 0)
            yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(row)), pa.array(names[row, place]), pa.array(scores[row, place])], schema=found)

    found = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
    dealt = docs.coalesce(groups)
    return reduce(DataFrame.unionAll, [dealt.mapInArrow(partial(answers, paths), "query_id long, doc_id long, score double") for paths in chunks or [[]]])
