"""Operator 11: alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs.

1. All texts are aligned once and written with their groups and links. Tasks add up how often each pair of ids is linked, and the
   distinct pairs get a minimal perfect hash.
2. The tasks' counts become dense vectors indexed by that hash (stored keys are verified), which are summed as a tree.
3. The written links look the counts up.

Linked tokens end at the same byte, so the bytes of one are a suffix of the other's. The vocabularies thus bound the number of
distinct pairs (``most_pairs``: at most the summed lengths of their entries, about 500,000), whatever the size of the corpus.

A text is encoded in units, cut at each single space between characters other than white space: neither tokenizer has an entry or
split that crosses such a place, and a unit's encoding doesn't depend on its neighbours. Units that a task meets again are aligned once.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import parts, slices
from tickloom.llm.dense import tree_sum
from tickloom.llm.perfect import PerfectHash
from tickloom.session import shared_dir, stage

#: units that a task keeps the alignment of
UNITS = 200_000
#: bytes of their groups that it keeps, so that long units go at once
BYTES = 1 << 27
#: units that are aligned at once
STEP = 20_000
#: longer units are aligned each time
LONGEST = 64

_CUT = re.compile(r" (?=\S)(?<=\S )")
_STATE: dict = {}


@dataclass(frozen=True, slots=True)
class Aligned:
    """Units one after the other: numbers of tokens and links of each, its groups as text, and all links as a << 32 | b. A unit that a side doesn't give back has no tokens."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    links: np.ndarray


class Aligner:
    """Alignment for two vocabulary files."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on
        shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
        back = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
        if set(back) != set(ByteLevel.alphabet()):
            raise ValueError(f"{byte_level} is not a byte-level vocabulary")
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        #: each id with the sign that follows it: 3 * id + 0, 1, 2
        self.signs = [f"{i}{sign}".encode() for i in range(max(len(self.a_bytes), len(self.b_bytes))) for sign in ",|;"]
        #: whether both ids of a link fit in four bytes
        self.narrow = max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16
        #: whether no piece has a space after another character; only then may units be encoded alone
        self.by_unit = not any(b" " in p.lstrip(b" ") for p in self.b_bytes)

    def most_pairs(self) -> int:
        """How many pairs (a, b) have the bytes of one as a suffix of the other's."""
        left, right = Counter(self.a_bytes), Counter(self.b_bytes)
        n = sum(k * right[x[i:]] for x, k in left.items() for i in range(len(x)))
        return n + sum(k * left[x[i:]] for x, k in right.items() for i in range(1, len(x)))

    def units(self, text: str) -> list[str]:
        """The units of space+text, each without its space."""
        return _CUT.split(text) if self.by_unit else [text]

    def align(self, units: list[str]) -> Aligned:
        """The alignment of each unit, with a space in front."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([f" {u}" for u in units], add_special_tokens=False)]
        ids_b = self.b.encode(units, num_threads=1)
        good = np.ones(len(units), bool)
        flat_a, flat_b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        raw = b"".join([f" {u}".encode() for u in units])
        if b"".join([self.a_bytes[i] for i in flat_a]) != raw or b"".join([self.b_bytes[i] for i in flat_b]) != raw:
            for k, (u, a, b) in enumerate(zip(units, ids_a, ids_b)):
                raw = f" {u}".encode()
                if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
                    good[k], ids_a[k], ids_b[k] = False, [], []
            flat_a, flat_b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        a, b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        # the units' bytes are equal on both sides, so offsets may run over all units
        end_a, end_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.zeros((2, (int(end_a[-1]) if len(a) else 0) + 1), bool)
        ends[0, end_a], ends[1, end_b] = True, True
        cut_a, cut_b = ends[1, end_a], ends[0, end_b]
        group = np.concatenate([2 * (np.cumsum(cut_a) - cut_a), 2 * (np.cumsum(cut_b) - cut_b) + 1])
        signs = np.concatenate([3 * a + cut_a, 3 * b + 2 * cut_b])[np.argsort(group, kind="stable")].tolist()
        text = [self.signs[i] for i in signs]
        stops = np.cumsum(n_a + n_b).tolist()
        groups = [b"".join(text[i:j])[:-1] for i, j in zip([0, *stops], stops)]
        before = np.append(0, np.cumsum(cut_a))
        stop_a = np.cumsum(n_a)
        return Aligned(good, n_a, n_b, before[stop_a] - before[stop_a - n_a], groups, a[cut_a] << 32 | b[cut_b])


def aligner(byte_level: str, pieces: str) -> Aligner:
    if _STATE.get("key") != (byte_level, pieces):
        _STATE.update(key=(byte_level, pieces), aligner=Aligner(byte_level, pieces))
    return _STATE["aligner"]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _added(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their numbers."""
    distinct, at = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, n)
    return distinct, total


def _packed(links: np.ndarray, narrow: bool) -> bytes:
    """Links, a << 32 | b, in eight bytes each, or in four if ``narrow``."""
    return ((links >> 32 << 16) | (links & 0xFFFF)).astype("<u4").tobytes() if narrow else links.astype("<i8").tobytes()


def _links(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """The links of all rows of a column of packed ones, one row after the other; ``n``: how many each row has."""
    raw = b"".join(column.to_pylist())
    if len(raw) == 8 * n.sum():
        return np.frombuffer(raw, "<i8")
    x = np.frombuffer(raw, "<u4").astype(np.int64)
    return (x >> 16 << 32) | (x & 0xFFFF)


class _Known:
    """The alignment of the units met so far, in Arrow arrays: a unit takes about as many bytes as its entries have."""

    def __init__(self, with_: Aligner):
        self.with_ = with_
        self.table: dict[str, int] = {}  # the place of each unit in what follows
        self.groups, self.links = pa.array([], pa.binary()), pa.array([], pa.list_(pa.uint32() if with_.narrow else pa.int64()))
        self.numbers = np.zeros((4, 0), np.int32)  # n_a, n_b, links, 1 if it has no tokens
        self.uses = np.zeros(0, np.int32)

    def add(self, units: list[str]) -> None:
        found = self.with_.align(units)
        self.table.update(zip(units, range(len(self.uses), len(self.uses) + len(units))))
        packed = np.frombuffer(_packed(found.links, self.with_.narrow), "<u4" if self.with_.narrow else "<i8")
        links = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(found.n_links)), pa.int32()), pa.array(packed))
        self.groups, self.links = pa.concat_arrays([self.groups, pa.array(found.groups, pa.binary())]), pa.concat_arrays([self.links, links])
        self.numbers = np.concatenate([self.numbers, np.stack([found.n_a, found.n_b, found.n_links, ~found.good]).astype(np.int32)], 1)
        self.uses = np.append(self.uses, np.zeros(len(units), np.int32))

    def forget(self) -> None:
        """The more used half stays, without long units."""
        order = np.argsort(-self.uses, kind="stable")[:UNITS // 2]
        units = list(self.table)
        kept = np.array([i for i in order.tolist() if len(units[i]) <= LONGEST and self.uses[i] > 1], np.int64)
        self.table = {units[i]: k for k, i in enumerate(kept.tolist())}
        self.groups, self.links = self.groups.take(pa.array(kept)), self.links.take(pa.array(kept))
        self.numbers, self.uses = self.numbers[:, kept], self.uses[kept] // 2


def aligned_texts(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, groups_sha256, links) of every row; links are packed, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = aligner(byte_level, pieces)
        width, known = 4 if with_.narrow else 8, _Known(with_)
        for batch in (x for whole in batches for x in parts(whole, "text")):
            texts = [with_.units(t) if t else [] for t in batch.column("text").to_pylist()]
            for left in batched(set(chain.from_iterable(texts)).difference(known.table), STEP):
                known.add(list(left))
            at = np.fromiter(map(known.table.__getitem__, chain.from_iterable(texts)), np.int64)
            known.uses += np.bincount(at, minlength=len(known.uses)).astype(np.int32)
            sizes = np.array([len(t) for t in texts], np.int64)
            row = np.repeat(np.arange(len(texts)), sizes)
            good = np.bincount(row, known.numbers[3, at], len(texts)) == 0
            at, row, sizes = at[good[row]], row[good[row]], sizes * good
            n_a, n_b, n = (np.bincount(row, x, len(texts)).astype(np.int64) for x in known.numbers[:3, at])
            taken = pa.array(at)
            groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), known.groups.take(taken)), pa.scalar(b";", pa.binary()))
            links = known.links.take(taken).flatten()
            ends = pa.array(np.append(0, width * np.cumsum(n)), pa.int32())
            links = pa.Array.from_buffers(pa.binary(), len(texts), [None, ends.buffers()[1], pa.array(links.to_numpy()).buffers()[1]])
            digests = [hashlib.sha256(g.as_buffer()).hexdigest() if some else "" for g, some in zip(groups, n_a.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_a, n_b, n, n)), groups, pa.array(digests, pa.string()), links], names)
            if len(known.table) > UNITS or known.groups.nbytes > BYTES:
                known.forget()

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "links"]
    return _texts(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, groups_sha256 string, links binary")


def linked_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, n): how often each id pair, a << 32 | b, is linked in the rows of ``aligned_texts`` of a task. A task gives each of its pairs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in (x for whole in batches for x in parts(whole, "links")):
            pairs, n = np.unique(_links(batch.column(1), batch.column(0).to_numpy()), return_counts=True)
            total = _added(np.concatenate([total[0], pairs]), np.concatenate([total[1], n]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], ["pair", "n"])

    return aligned.select("n_links", "links").mapInArrow(run, "pair long, n long")


def align_tokens(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256) of every row of ``docs`` (doc_id, text).

    Side A encodes space+text by the byte-level vocabulary, side B the text by the piece vocabulary, which adds the space; strings of special
    tokens are plain text. Byte offsets where tokens of both sides end cut the tokens into groups, and the two tokens that end
    there are linked. The count of an id pair is the number of its links in all texts; n_best counts the links
    whose pair has the highest count of its B id (ties included), count_sum adds up the counts over links. groups is the UTF-8 text
    ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and texts that a side doesn't give back byte by byte, have zeros and '' in
    groups and groups_sha256. Rows that repeat count each time; whole texts are read; other columns are left out. An empty table gives no rows.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    found = aligned_texts(docs, byte_level, pieces)
    # small row groups: what a task holds until it writes them doesn't grow with its input
    found.write.option("compression", "zstd").option("parquet.block.size", 1 << 24).parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    pairs = stage(linked_pairs(found))
    # bounded by the vocabularies (see most_pairs)
    index = PerfectHash(pairs.select("pair").distinct().toArrow()["pair"].to_numpy().view(np.uint64))

    def local(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(len(index), np.int64)
        for batch in batches:
            at = index.index(batch.column("pair").to_numpy().view(np.uint64))
            if (at < 0).any():
                raise ValueError("a pair without a number")
            np.add.at(total, at, batch.column("n").to_numpy())
        return total

    counts = tree_sum(pairs, len(index), np.int64, local)
    to = (index.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    highest = np.zeros(int(to.max()) + 1 if len(to) else 1, np.int64)
    np.maximum.at(highest, to, counts)
    best = counts == highest[to]

    @F.arrow_udf("n_best long, count_sum long")
    def looked_up(n: pa.Array, links: pa.Array) -> pa.Array:
        sums = np.zeros((2, len(n)), np.int64)
        for i, j in slices(links):  # a few links at once
            some = n[i:j].to_numpy()
            at = index.index(_links(links[i:j], some).view(np.uint64))
            if (at < 0).any():
                raise ValueError("a pair without a count")
            stops = np.cumsum(some)
            for k, x in enumerate((best, counts)):
                total = np.append(0, np.cumsum(x[at]))
                sums[k, i:j] = total[stops] - total[stops - some]
        return pa.StructArray.from_arrays([pa.array(x) for x in sums], ["n_best", "count_sum"])

    out = found.withColumn("_counts", looked_up("n_links", "links"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "_counts.n_best", "_counts.count_sum", "groups", "groups_sha256")
