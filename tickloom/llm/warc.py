"""Operator 9: WARC archives, and a normaliser for archives that are one gzip stream.

``write_archives`` writes a record per page as one gzip stream per file, the way a plain ``gzip`` of a WARC file looks.
``normalise`` inflates each such file once, as a stream, writes every record as a gzip member of its own
and puts an offset index beside the file. ``read_records`` reads single records by that index.

Files lie below a folder that all executors reach (spark.checkpoint.dir). Every task attempt writes names of its own, and
only files named in a written table count, so lost executors and repeated attempts leave no wrong records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = 1 << 20
_DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"

INDEX = "page_id long, path string, offset long, length long, record_type string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, html, digest, refers_to): html "" for null; refers_to is set for copies of a payload of ``least`` bytes or more.

    Of equal payloads the largest page_id keeps the payload; a null page_id never does while another row has an id. Rows with the same id and
    payload all keep it. Payloads are equal if their SHA-1 and length are. Counting combines before its shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html"))
    copies = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("best"), F.count("*").alias("c")).where("c > 1 and best is not null").drop("c")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("best")), F.col("best"))
    return rows.join(copies, ["digest", "n"], "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>")
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += [f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def write_archives(pages: DataFrame, folder: str, file_bytes: int = 1 << 28) -> DataFrame:
    """(path, records) of the archives written below ``folder``; ``pages`` as from ``with_revisits``.

    Each task writes a file after another, each one gzip stream of about ``file_bytes`` inflated bytes. Stage the result before
    reading the files: they are written when it runs. An empty table gives no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        out = None
        done: list[tuple[str, int]] = []
        n = size = 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    path = f"{root}/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, gz, n, size = files.open_output_stream(path, compression=None), zlib.compressobj(4, zlib.DEFLATED, 31), 0, 0
                record = _record(page_id, url, html.encode(), digest, refers_to)
                out.write(gz.compress(record))
                n, size = n + 1, size + len(record)
                if size >= file_bytes:
                    out.write(gz.flush())
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "records": [x[1] for x in done]}, schema=schema)

    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])
    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, records long")


def _inflate(stream) -> Iterator[bytes]:
    """Chunks of a gzip file with one member or many."""
    gz = zlib.decompressobj(31)
    while data := stream.read(_CHUNK):
        while data:
            yield gz.decompress(data)
            data = gz.unused_data
            if gz.eof:
                gz = zlib.decompressobj(31)
    yield gz.flush()


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) of each record; holds one record at a time."""
    buffer = bytearray()
    for chunk in chunks:
        buffer += chunk
        at = 0
        while (end := buffer.find(_END, at)) >= 0:
            lines = bytes(buffer[at:end]).decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            stop = end + 4 + int(fields["Content-Length"]) + 4
            if len(buffer) < stop:
                break
            yield fields, bytes(buffer[at:stop])
            at = stop
        del buffer[:at]
    if buffer:
        raise ValueError("an archive ends within a record")


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, path, offset, length, record_type, refers_to) of every record of ``archives`` (path).

    Each archive is inflated once and written anew below ``folder``, a gzip member per record; ``<name>.cdxj`` beside it has a line per record
    with the same fields. Accepts files that already have a member per record. Memory: one record. ``archives`` should be a written table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, name = _files(path)
                target = f"{root}/{name.rsplit('/', 1)[-1][:-8]}-{uuid.uuid4().hex}.warc.gz"
                rows: list[tuple] = []
                with source.open_input_stream(name, compression=None) as stream, files.open_output_stream(target, compression=None) as out, files.open_output_stream(f"{target[:-8]}.cdxj", compression=None) as index:
                    at = 0
                    for fields, record in _records(_inflate(stream)):
                        gz = zlib.compressobj(4, zlib.DEFLATED, 31)
                        member = gz.compress(record) + gz.flush()
                        out.write(member)
                        row = (_page(fields.get("WARC-Record-ID")), target, at, len(member), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")))
                        index.write(json.dumps(dict(zip(names, row))).encode() + b"\n")
                        rows.append(row)
                        at += len(member)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    names = [c.split()[0] for c in INDEX.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))))
    return archives.select("path").repartition(max(1, min(archives.count(), 10_000)), "path").mapInArrow(run, INDEX)


def read_records(index: DataFrame, with_payload: bool = True, span: int = 1 << 26) -> DataFrame:
    """The record of every row of ``index``, read by its offset: RECORDS columns.

    payload_bytes and payload_digest (lower-case hex) are those of the full payload: computed from a response's payload, which must agree
    with its header, and taken from the headers of a revisit. Reads of one file are split by ``span`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stream = None, None
        for batch in batches:
            rows: list[tuple] = []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path != at:
                    files, name = _files(path)
                    at, stream = path, files.open_input_file(name)
                stream.seek(offset)
                fields, record = next(_records(iter([zlib.decompress(stream.read(length), 31)])))
                block = record[record.index(_END) + 4:-4]
                head, _, payload = block.partition(_END)
                http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                response = fields["WARC-Type"] == "response"
                if response and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"{path} at {offset}: payload and header differ")
                rows.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")),
                             int(http["Content-Length"]), digest, payload if response and with_payload else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    part = F.floor(F.col("offset") / span)
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: rows are small, what they point to isn't
    return index.select("path", "offset", "length").repartition(tasks, "path", part).sortWithinPartitions("path", "offset").mapInArrow(run, RECORDS)
