"""Operator 1: n-gram Jaccard self-join by a token-group matrix.

1. Texts with equal shingle sets form one class; all later work is on classes.
2. A count sketch of fixed size over all texts gives one order of all shingles, frequent ones last. Linked sets
   share a shingle among their first n - ceil(t*n) + 1 ones.
3. Classes are partitioned into stars: a class joins a leader that it is linked with. Buckets share two minhashes; a
   large bucket is cut into pieces. Leaders are tried again with other minhashes, so a large family of near copies ends in a
   few stars. Stars whose leaders share a minhash, linked or not, form a group of similar sets.
4. A group stores the union of its members' shingles (split in blocks of members), as a matrix of shingles by members. A
   class is a query to each group that holds enough of its first shingles; a group is opened only if the union holds
   t*n of the query's shingles. An open group gives a link to a star at most once for each star of a query.
5. Components of the graph of stars give the result. No pair within a group is ever written out.

The result is exact up to 64-bit hash equality: grouping and the bit sets (fixed sizes, only to keep rows from being
shuffled) decide how much work there is, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import mix, parts
from tickloom.llm.graph import components
from tickloom.llm.shingles import fingerprint, shingle_sets
from tickloom.llm.sketch import bit_set, counts, has
from tickloom.session import stage


@dataclass(frozen=True)
class JaccardSpec:
    """``words`` per shingle; linked when den * intersection >= num * union. The rest only steers the work."""

    words: int = 5
    num: int = 80
    den: int = 100
    sketch_bits: int = 18
    filter_bits: int = 24
    block: int = 256
    rounds: int = 4
    slice_bytes: int = 1 << 22

    @property
    def least(self) -> int:
        """Smaller sets are linked with equal sets only: n / (n + 1) is below the threshold."""
        return -(-self.num // (self.den - self.num)) if self.num < self.den else 1 << 40

    def prefix(self, n: int) -> int:
        return n + (-n * self.num // self.den) + 1  # n - ceil(t * n) + 1

    def linked(self, both: int, n: int, m: int) -> bool:
        return self.den * both >= self.num * (n + m - both)


def _order(s: np.ndarray, sketch: np.ndarray, spec: JaccardSpec) -> np.ndarray:
    return np.lexsort((mix(s), sketch[(s >> np.uint64(64 - spec.sketch_bits)).astype(np.int64)]))


def _classes(docs: DataFrame, spec: JaccardSpec) -> DataFrame:
    """(doc_id, cid, n, keys, first): each text's class, set size, minhashes, and first shingles in the sketch's order."""
    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        sets = shingle_sets(batch.column(0), spec.words)
        return np.concatenate(sets) if sets else np.zeros(0, np.uint64)

    sketch = docs.sparkSession.sparkContext.broadcast(counts(docs.select("text"), spec.sketch_bits, hashes))
    salts = mix(np.arange(1, 2 * spec.rounds + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in parts(whole, "text", spec.slice_bytes)):
            cid, size, keys, first = [], [], [], []
            for s in shingle_sets(batch.column("text"), spec.words):
                n = len(s)
                size.append(n)
                cid.append(fingerprint(s) if n else None)
                if n >= spec.least:
                    low = np.array([mix(s ^ x).min() for x in salts], np.uint64)
                    keys.append(mix(low[::2] * np.uint64(3) + low[1::2]).view(np.int64))
                    first.append(s[_order(s, sketch.value, spec)[:spec.prefix(n)]].view(np.int64))
                else:
                    keys.append(None)
                    first.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cid, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, longs), pa.array(first, longs)], ["doc_id", "cid", "n", "keys", "first"])

    longs = pa.list_(pa.int64())
    return docs.mapInArrow(run, "doc_id long, cid long, n long, keys array<long>, first array<long>")


def _mark(cid: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return mix(cid.view(np.uint64) ^ mix(doc_id.view(np.uint64)))


def _sets(docs: DataFrame, wanted: DataFrame, spec: JaccardSpec) -> DataFrame:
    """(cid, n, tokens) of the ``wanted`` (cid, rep), and of few others; tokens are little-endian 64-bit numbers."""
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_mark(b.column(0).to_numpy(), b.column(1).to_numpy()).view(np.int64))], ["mark"])

    keep = docs.sparkSession.sparkContext.broadcast(bit_set(wanted.select("cid", F.coalesce("rep", F.lit(0)).alias("rep")).mapInArrow(marks, "mark long"), spec.filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in parts(whole, "text", spec.slice_bytes)):
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            sets = [(fingerprint(s), s, i) for s, i in zip(shingle_sets(batch.column("text"), spec.words), ids) if len(s) >= spec.least]
            if sets:
                some = has(keep.value, _mark(np.array([x[0] for x in sets], np.int64), np.array([x[2] for x in sets], np.int64)))
                sets = [x for x, y in zip(sets, some) if y]
            yield pa.RecordBatch.from_pydict({"cid": [x[0] for x in sets], "n": [len(x[1]) for x in sets], "tokens": [x[1].tobytes() for x in sets]}, schema=schema)

    schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
    return docs.mapInArrow(run, "cid long, n long, tokens binary")


def _lead(pieces: DataFrame, sets: DataFrame, spec: JaccardSpec) -> DataFrame:
    """(cid, leader): classes that are linked with a leader of their piece. pieces: (cid, key, piece)."""
    rows = pieces.join(sets, "cid").select("key", "piece", "n", "cid", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, post, leaders = None, {}, []
        for batch in batches:
            got, lead = [], []
            for key, piece, n, cid, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if (key, piece) != at:
                    at, post, leaders = (key, piece), {}, []
                s = np.frombuffer(tokens.as_buffer(), np.uint64).tolist()
                hits: dict[int, int] = {}
                for t in s:
                    for g in post.get(t, ()):
                        hits[g] = hits.get(g, 0) + 1
                best = next((g for g, both in hits.items() if spec.linked(both, n, leaders[g][1])), None)
                if best is None:
                    for t in s:
                        post.setdefault(t, []).append(len(leaders))
                    leaders.append((cid, n))
                elif leaders[best][0] != cid:  # not the same class once more
                    got.append(cid)
                    lead.append(leaders[best][0])
            yield pa.RecordBatch.from_pydict({"cid": got, "leader": lead}, schema=schema)

    schema = pa.schema([("cid", pa.int64()), ("leader", pa.int64())])
    return rows.repartition("key", "piece").sortWithinPartitions("key", "piece", "n", "cid").mapInArrow(run, "cid long, leader long").dropDuplicates(["cid"])


def _with_counts(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of keys that occur twice or more, with their number c. A hot key is spread over 64 salts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(64)))
    per = salted.groupBy(*key, "salt").agg(F.count("*").alias("c"))
    total = per.groupBy(*key).agg(F.sum("c").alias("c")).where("c > 1")
    return salted.join(per.drop("c").join(total, list(key)), [*key, "salt"]).drop("salt")


def _stars(docs: DataFrame, classes: DataFrame, spec: JaccardSpec) -> tuple[DataFrame, DataFrame] | None:
    """(cid, grp): classes in another class's star; (grp, cell): stars in a group of similar sets. None if there are no shared minhashes."""
    keyed = classes.where(F.col("keys").isNotNull()).select("cid", "rep", F.posexplode("keys").alias("round", "key"))
    some = stage(_with_counts(keyed, "round", "key").drop("c"))
    if not some.limit(1).count():
        return None
    sets = stage(_sets(docs, some.select("cid", "rep").distinct(), spec))
    groups = None
    for r in range(spec.rounds):
        rows = some.where(F.col("round") == r).select("cid", "key")
        if groups is not None:
            rows = rows.join(groups, "cid", "left_anti")
        pieces = _with_counts(rows, "key").select("cid", "key", F.pmod(F.xxhash64("cid"), F.ceil(F.col("c") / spec.block)).cast("long").alias("piece"))
        led = stage(_lead(pieces, sets, spec))
        moved = led.select("cid", F.col("leader").alias("grp"))
        if groups is not None:
            step = led.select(F.col("cid").alias("grp"), "leader")
            moved = groups.join(step, "grp", "left").select("cid", F.coalesce("leader", "grp").alias("grp")).union(moved)
        groups = stage(moved)
    cells = None
    for r in range(spec.rounds):
        rows = some.where(F.col("round") == r).select("cid", "key").join(groups, "cid", "left_anti")
        if cells is not None:
            rows = rows.join(cells.select("cid"), "cid", "left_anti")
        cell = F.xxhash64(F.lit(r), "key", F.pmod(F.xxhash64("cid"), F.ceil(F.col("c") / spec.block)))
        found = _with_counts(rows, "key").select("cid", cell.alias("cell"))
        cells = stage(found if cells is None else cells.union(found))
    return groups, cells.withColumnRenamed("cid", "grp")


def _least_shared(spec: JaccardSpec, n: Column, m: Column) -> Column:
    """First shingles that linked sets of these sizes share at least: the overlap they need, less all others of either one."""
    def others(x: Column) -> Column:
        return F.ceil(x * spec.num / spec.den) - 1

    return F.lit(spec.num) * (n + m) / (spec.num + spec.den) - F.greatest(others(n), others(m))


def _pairs(rows: DataFrame, label: DataFrame, spec: JaccardSpec) -> DataFrame:
    """(cid, rep, own, cell): queries and the groups that may hold a set linked with them. label: (cid, rep, grp, cell)."""
    able = rows.where(F.col("first").isNotNull()).select("cid", "doc_id", "n", "first")
    grouped = stage(able.join(label, "cid").where("doc_id <=> rep").drop("doc_id"))
    tokens = grouped.select("grp", F.explode("first").alias("token"))
    shared = stage(tokens.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token"))
    keep = rows.sparkSession.sparkContext.broadcast(bit_set(shared, spec.filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("first")
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            some = has(keep.value, flat.view(np.uint64))
            at = np.repeat(np.arange(len(sizes)), sizes)[some]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("cid", "rep", "n", "grp", "cell")] + [pa.array(flat[some])], ["cid", "rep", "n", "grp", "cell", "token"])

    held = stage(grouped.mapInArrow(run, "cid long, rep long, n long, grp long, cell long, token long").join(shared, "token"))
    aims = held.groupBy("token", "cell").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("grp").alias("a"), F.max("grp").alias("b"))
    sizes = held.groupBy("cell").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    asks = held.select("token", "cid", "rep", "n", F.col("grp").alias("own"), F.col("cell").alias("home"))
    fits = (F.col("n") * spec.num <= F.col("hi") * spec.den) & (F.col("lo") * spec.num <= F.col("n") * spec.den)
    other = (F.col("home") > F.col("cell")) | ((F.col("home") == F.col("cell")) & ((F.col("own") != F.col("a")) | (F.col("own") != F.col("b"))))
    common = asks.join(aims, "token").where(other & fits).groupBy("cid", "rep", "n", "own", "cell").agg(F.count("*").alias("c"))
    low = F.greatest(F.col("lo").cast("double"), F.col("n") * spec.num / spec.den)
    high = F.least(F.col("hi").cast("double"), F.col("n") * spec.den / spec.num)
    need = F.least(_least_shared(spec, F.col("n"), low), _least_shared(spec, F.col("n"), high), F.when(F.col("n").between(F.col("lo"), F.col("hi")), _least_shared(spec, F.col("n"), F.col("n"))))
    return common.join(sizes, "cell").where(F.col("c") + 2 >= need).select("cid", "rep", "own", "cell")


def _edges(pairs: DataFrame, members: DataFrame, sets: DataFrame, spec: JaccardSpec) -> DataFrame:
    """(a, b): linked stars. pairs: (cid, own, cell); members: (cid, grp, cell)."""
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / spec.block).alias("blocks"))
    held = members.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("long").alias("block"), F.lit(0).alias("kind"), "cid", F.col("grp").alias("own"))
    asks = pairs.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "cid", "own")
    rows = held.union(asks).join(sets, "cid").select("cell", "block", "kind", "n", "own", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, group = None, [], None
        for batch in batches:
            a, b = [], []
            for cell, block, kind, n, own, tokens in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5)):
                s = np.frombuffer(tokens.as_buffer(), np.uint64)
                if (cell, block) != at:
                    at, inside, group = (cell, block), [], None
                if kind == 0:
                    inside.append((own, s.copy()))
                    continue
                if group is None:
                    group = _Group(inside, spec)
                for star in group.linked(own, s):
                    a.append(own)
                    b.append(star)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(run, "a long, b long").distinct()


class _Group:
    """A block of members of a group: the union of their shingles, and which member has which."""

    def __init__(self, members: list[tuple[int, np.ndarray]], spec: JaccardSpec):
        self.spec, self.stars, self.sets = spec, [m[0] for m in members], [m[1] for m in members]
        self.sizes = np.array([len(s) for s in self.sets])
        self.union = np.unique(np.concatenate(self.sets)) if members else np.zeros(0, np.uint64)
        self.matrix = None
        if len(self.union) * len(members) <= 1 << 26:
            self.matrix = np.zeros((len(self.union), len(members)), np.uint8)
            for i, s in enumerate(self.sets):
                self.matrix[np.searchsorted(self.union, s), i] = 1
        self.root: dict[int, int] = {}

    def _find(self, x: int) -> int:
        while (y := self.root.get(x, x)) != x:
            x = y
        return x

    def linked(self, own: int, s: np.ndarray) -> list[int]:
        """Stars with a member linked with ``s``, each only once for all that is joined with it already."""
        n = len(s)
        at = np.minimum(np.searchsorted(self.union, s), max(0, len(self.union) - 1))
        at = at[self.union[at] == s] if len(self.union) else at[:0]
        if self.spec.den * len(at) < self.spec.num * n:
            return []
        fits = (self.spec.num * n <= self.spec.den * self.sizes) & (self.spec.num * self.sizes <= self.spec.den * n)
        if self.matrix is not None:
            both = self.matrix[at].sum(0, dtype=np.int64)
        else:
            both = np.array([len(np.intersect1d(s, m, assume_unique=True)) if f else 0 for m, f in zip(self.sets, fits)])
        out = []
        for i in np.flatnonzero(fits & (self.spec.den * both >= self.spec.num * (n + self.sizes - both))).tolist():
            x, y = self._find(own), self._find(self.stars[i])
            if x != y:
                self.root[x] = y
                out.append(self.stars[i])
        return out


def _joined(docs: DataFrame, label: DataFrame, pairs: DataFrame, spec: JaccardSpec) -> DataFrame:
    """(cid, rep, grp) with one grp for all stars that are linked."""
    members = stage(label.join(pairs.select("cell").distinct(), "cell", "left_semi"))
    sets = stage(_sets(docs, members.select("cid", "rep").union(pairs.select("cid", "rep")).distinct(), spec))
    found = components(stage(_edges(pairs, members, sets, spec))).select(F.col("node").alias("grp"), "label")
    return label.join(found, "grp", "left").select("cid", "rep", F.coalesce("label", "grp").alias("grp"))


def jaccard_components(docs: DataFrame, spec: JaccardSpec = JaccardSpec()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links between shingle sets with a Jaccard similarity of
    num/den or more. Texts without words have no shingles and are linked with nothing: their component is
    their own doc_id. Repeated rows and repeated ids stay rows of their own and are linked through their texts.
    A null doc_id takes part, but is the component only where no row of the component has an id.
    An empty table gives no rows.
    """
    return jaccard_rows(docs, spec).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, spec: JaccardSpec = JaccardSpec()) -> DataFrame:
    """The rows of ``jaccard_components`` with cid, which names the row's shingle set, and grp, which names its component.

    Where ids repeat or are null, component_id doesn't tell components apart; grp does. Both are null for texts without words.
    """
    rows, of = _found(docs, spec)
    some = rows.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "cid").join(of, "cid").select("doc_id", "n_shingles", "component_id", "cid", "grp")
    none = F.lit(None).cast("long")
    return some.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("cid"), none.alias("grp")))


def _found(docs: DataFrame, spec: JaccardSpec) -> tuple[DataFrame, DataFrame]:
    """The rows with their class (doc_id, cid, n), and the component of each class (cid, grp, component_id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(_classes(docs, spec))
    classes = stage(rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")))
    found = _stars(docs, classes, spec)
    label = classes.select("cid", "rep", F.col("cid").alias("grp"), F.col("cid").alias("cell"))
    if found is not None:
        label = classes.select("cid", "rep").join(found[0], "cid", "left").select("cid", "rep", F.coalesce("grp", "cid").alias("grp"))
        label = stage(label.join(found[1], "grp", "left").select("cid", "rep", "grp", F.coalesce("cell", "grp").alias("cell")))
    pairs = stage(_pairs(rows, label, spec))
    label = label.drop("cell") if not pairs.limit(1).count() else _joined(docs, label, pairs, spec)
    lowest = label.groupBy("grp").agg(F.min("rep").alias("component_id"))
    return rows, label.join(lowest, "grp").select("cid", "grp", "component_id")
