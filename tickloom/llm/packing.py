"""Operator 7: pack documents into windows by Karmarkar-Karp multiway differencing.

A document's ids, with an end id, are cut into pieces: whole windows first, then pieces of ``cut`` ids at most.
Whole windows stand alone, in blocks of their own. The other pieces are dealt by hash into blocks of about ``block`` windows, and each block
is partitioned into k windows: every piece starts as a partial partition, and the two partial partitions with the
largest imbalance are merged so that the fullest window of one meets the emptiest of the other. k starts at the
ids of the block over the capacity and rises by one as long as a window is over the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import parts
from tickloom.llm.tokens import TokenCoder
from tickloom.session import shared_dir, stage

#: what a sequence says of each of its pieces
MEMBERS = ("doc_id", "start", "length", "doc_tokens", "offset")
#: bytes of text whose words are looked up together
TEXT_BYTES = 1 << 23
PIECES = "doc_id long, start long, length long, doc_tokens long, row_key long, ids binary, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 2048, cut: int = 512, end_id: int = 1, with_ids: bool = True, narrow: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, row_key, ids, ids_crc32) of all documents.

    ids are little-endian unsigned 32-bit numbers; without ``with_ids`` they are left null and only their checksum is kept. With
    ``narrow``, ids of a document whose ids are all below 2**16 take two bytes each (see ``_wide``). A null or empty text has the end id alone. Repeated rows give pieces of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TokenCoder(tokenizer)
        for batch in (x for whole in batches for x in parts(whole, "text", TEXT_BYTES)):
            found, counts = coder.many(batch.column("text"))
            stops = np.cumsum(counts)
            found = np.insert(found, stops, end_id).astype("<u4")
            stops += np.arange(1, len(stops) + 1)
            rows: list[tuple] = []
            for doc_id, first, stop in zip(batch.column("doc_id").to_pylist(), [0, *stops.tolist()], stops.tolist()):
                own, n = found[first:stop], stop - first
                ids = own.tobytes()
                whole = zlib.crc32(ids)
                kept, step = ids, 4
                if narrow and own.max() < 1 << 16:
                    kept, step = own.astype("<u2").tobytes(), 2
                at = 0
                while at < n:
                    left = n - at
                    length = window if left >= window else min(cut, left)
                    crc = zlib.crc32(ids[4 * at:4 * (at + length)])
                    rows.append((doc_id, at, length, n, (whole << 30) ^ (crc << 7) ^ at, kept[step * at:step * (at + length)] if with_ids else None, crc))
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.binary() if n == "ids" else pa.int64() for n in names]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def _wide(part: bytes, length: int) -> bytes:
    """``length`` ids in four bytes each."""
    return part if len(part) == 4 * length else np.frombuffer(part, "<u2").astype("<u4").tobytes()


def differencing(lengths: list[int], k: int) -> list[int]:
    """The window of each length, of ``k``, by largest-differencing merges of partial partitions."""
    nodes: list[tuple[np.ndarray, np.ndarray]] = []  # sums, from the largest down; the tree of each window, or -1
    parent = list(range(len(lengths)))
    heap: list[tuple[int, int]] = []
    for i, n in enumerate(lengths):
        sums, trees = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], trees[0] = n, i
        nodes.append((sums, trees))
        heap.append((-n, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        (a, s), (b, t) = nodes[i], nodes[j]
        b, t = b[::-1], t[::-1]
        for x in np.flatnonzero((s >= 0) & (t >= 0)).tolist():
            parent[t[x]] = int(s[x])
        sums, trees = a + b, np.where(s >= 0, s, t)
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], trees[order]
        sums -= sums[-1]
        nodes[i], nodes[j] = (sums, trees), None
        heapq.heappush(heap, (-int(sums[0]), i))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    place = {int(t): w for w, t in enumerate(nodes[heap[0][1]][1]) if t >= 0} if heap else {}
    return [place[root(i)] for i in range(len(lengths))]


def fill_windows(lengths: list[int], window: int) -> list[int]:
    """A window for each length so that no window is over its capacity."""
    if not lengths:
        return []
    k = -(-sum(lengths) // window)
    while True:
        found = differencing(lengths, k)
        if np.bincount(found, lengths).max() <= window:
            return found
        k += 1


def pack(pieces: DataFrame, window: int = 2048, block: int = 64) -> DataFrame:
    """Adds sequence_id and offset to every piece; ``pieces`` has doc_id, start, length and row_key. Other columns, such as ids, go along.

    Blocks are dealt by hash: pieces of a hot document or source, and copies, spread evenly. Pieces of equal blocks meet in
    one task, at most about ``block`` windows; whole windows have blocks of their own, so that a block's ids stay small however
    many there are. Sequence ids are block * 2**20 + window.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return _dealt(pieces, window, block).groupBy("block").applyInArrow(lambda table: _placed(table, window), schema)


def _dealt(pieces: DataFrame, window: int, block: int) -> DataFrame:
    """Adds the block of every piece."""
    part = F.col("length") < window
    total = pieces.agg(F.sum(F.when(part, F.col("length"))), F.sum(F.when(~part, F.lit(1)))).first()
    blocks, full_blocks = max(1, (total[0] or 0) // (window * block)), max(1, (total[1] or 0) // block)
    key = F.xxhash64("doc_id", "start", "row_key")
    return pieces.withColumn("block", F.when(part, F.pmod(key, F.lit(blocks))).otherwise(F.lit(blocks) + F.pmod(key, F.lit(full_blocks))))


def _placed(table: pa.Table, window: int) -> pa.Table:
    """The pieces of one block by sequence and offset."""
    table = table.take(pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("row_key", "ascending")]))
    length = table.column("length").to_numpy()
    full = int((length >= window).sum())
    found = np.concatenate([np.arange(full), full + np.array(fill_windows(length[full:].tolist(), window), np.int64)]).astype(np.int64)
    order = np.argsort(found, kind="stable")
    table, found, length = table.take(pa.array(order)), found[order], length[order]
    ends = np.cumsum(length)
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    offset = ends - length - np.repeat((ends - length)[first], np.diff(np.append(first, len(found))))
    block_id = table.column("block").to_numpy()
    return table.drop_columns("block").append_column("sequence_id", pa.array(block_id * (1 << 20) + found)).append_column("offset", pa.array(offset))


def _joined(table: pa.Table) -> pa.Table:
    """The sequences of one block, from its pieces by sequence and offset."""
    table = table.combine_chunks()
    at, length = table.column("sequence_id").to_numpy(), table.column("length").to_numpy()
    stops = np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)) if len(at) else np.zeros(0, np.int64)
    first = np.append(0, stops)
    ids = b"".join(map(_wide, table.column("ids").to_pylist(), length.tolist()))
    ends = 4 * np.append(0, np.cumsum(length))[first]
    members = pa.StructArray.from_arrays([pa.array(table.column(n).to_pylist(), pa.int64()) for n in MEMBERS], list(MEMBERS))
    return pa.table({
        "sequence_id": pa.array(at[first[:-1]]),
        "ids": pa.array([ids[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())], pa.binary()),
        "pieces": pa.ListArray.from_arrays(pa.array(first, pa.int32()), members),
    })


def sequences(docs: DataFrame, tokenizer: str, path: str | None = None, window: int = 2048, block: int = 64) -> DataFrame:
    """The sequences of ``docs`` (sequence_id, ids, pieces), written as Parquet at ``path`` (or below the shared folder) and read back.

    ids are little-endian unsigned 32-bit numbers, those of a sequence's pieces one after the other; pieces (doc_id, start, length, doc_tokens,
    offset) are by offset, and offset and length count ids. An empty table gives no sequences.
    """
    schema = f"sequence_id long, ids binary, pieces array<struct<{', '.join(f'`{n}`: long' for n in MEMBERS)}>>"
    pieces = stage(token_pieces(docs, tokenizer, window, narrow=True).drop("ids_crc32"))
    found = _dealt(pieces, window, block).groupBy("block").applyInArrow(lambda table: _joined(_placed(table, window)), schema)
    path = path or shared_dir(docs.sparkSession)
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def placed_pieces(found: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of ``sequences``; the checksum is that of its ids there."""
    each = found.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    crc = F.crc32(F.expr("substring(ids, int(4 * p.offset + 1), int(4 * p.length))"))
    return each.select("p.doc_id", "p.start", "p.length", crc.alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
