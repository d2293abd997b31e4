"""WARC archives: a monolithic gzip writer, a normaliser to one gzip member a record with a sidecar index, a reader.

Files are written and read through pyarrow.fs by the URI of the shared folder, so any store with a URI that it knows
serves. Each attempt of a task writes files of its own names; only the names of the attempts that Spark kept come back
in the manifest, so lost executors and repeated attempts leave no half-written archive in the result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, ship, table, text_or_empty

ship(__name__)

#: Bytes of records, before compression, after which a writer begins its next archive.
ARCHIVE_BYTES = 256 << 20
LEVEL = 4
CHUNK = 1 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def payload_digest() -> Column:
    return F.sha1(F.encode(text_or_empty("html"), "utf-8"))


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload of at least min_bytes a page of a larger id has too.

    Only ids and digests are shuffled. The heads of groups of two or more are joined with the ids by digest; a hot
    digest stands once on the heads' side, so Spark can split the other.
    """
    digests = pages.select("page_id", payload_digest().alias("digest"), F.octet_length(text_or_empty("html")).alias("size")).filter(F.col("size") >= min_bytes)
    heads = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return digests.join(heads, "digest").filter("page_id < refers_to").select("page_id", "digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps digest and length of its payload, not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"page:{page_id}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{refers_to}')}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) as whole-file gzip archives; one row (path, records, bytes) each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        done, out = [], None
        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            for k in range(batch.num_rows):
                page_id, url, html, refers_to = (c[k].as_py() for c in columns)
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, packer, n, size = store.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                data = record(page_id, url, (html or "").encode(), refers_to)
                out.write(packer.compress(data))
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.write(packer.flush())
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["path", "records", "bytes"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, records long, bytes long")


def records_of(source, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of a WARC stream that is one gzip stream (or several members), inflated once, front to back."""
    packer, held = zlib.decompressobj(31), bytearray()
    at = 0  # held before it was handed out
    while data := source.read(chunk):
        while data:
            held += packer.decompress(data)
            data = packer.unused_data
            if packer.eof:
                packer = zlib.decompressobj(31)
            else:
                data = b""
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            length = int(held[held.index(b"\r\nContent-Length: ", at, end + 2) + 18 : end].split(b"\r\n", 1)[0])
            if len(held) < end + 8 + length:
                break
            yield bytes(held[at : end + 8 + length])
            at = end + 8 + length
        if at > chunk:
            del held[:at]
            at = 0
    if at != len(held):
        raise ValueError(f"{len(held) - at} bytes after the last whole record")


def normalise_archives(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites each archive with a gzip member of its own for every record and writes `<name>.idx` beside it.

    An index line is a JSON object: offset and length of the member, and the record's page. Returns a row
    (path, index, records, bytes) for each archive. A task holds one record and one chunk of the stream at a time.
    """

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path, n, offset = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                with store.open_input_stream(source, compression=None) as data, store.open_output_stream(path, compression=None) as out, store.open_output_stream(f"{path}.idx", compression=None) as index:
                    for rec in records_of(data):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(rec) + packer.flush()
                        out.write(member)
                        index.write(b'{"offset":%d,"length":%d,"record":%d}\n' % (offset, len(member), n))
                        n, offset = n + 1, offset + len(member)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f"{path}.idx"]), pa.array([n], pa.int64()), pa.array([offset], pa.int64())], ["path", "index", "records", "bytes"])

    spread = archives.select("path").repartition(archives.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(normalise, "path string, index string, records long, bytes long")


def parse(rec: bytes) -> dict:
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields | {"block": rest[: int(fields["Content-Length"])]}


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives: each member is sought by the index, inflated alone and checked.

    Of a response the payload is hashed anew; of a revisit the digest and length are those that its record names.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_offset", "record_length"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with store.open_input_file(path) as data, store.open_input_stream(index, compression=None) as lines:
                    for line in _lines(lines):
                        at = json.loads(line)
                        data.seek(at["offset"])
                        x = parse(zlib.decompress(data.read(at["length"]), 31))
                        digest, size = x["WARC-Payload-Digest"].removeprefix("sha1:"), int(x["WARC-Payload-Length"])
                        if x["WARC-Type"] == "response":
                            if base64.b32encode(hashlib.sha1(x["block"]).digest()).decode() != digest or len(x["block"]) != size:
                                raise ValueError(f"{path} at {at['offset']}: payload and digest differ")
                        refers = x.get("WARC-Refers-To-Page-ID")
                        rows.append((int(x["WARC-Page-ID"]) if x["WARC-Page-ID"] else None, json.loads(f'"{x["WARC-Target-URI"]}"'), size, digest, x["WARC-Type"], int(refers) if refers else None, at["offset"], at["length"]))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_offset long, record_length long"
    spread = archives.select("path", "index").repartition(archives.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(read, schema)


def _lines(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    held = b""
    while data := stream.read(chunk):
        *whole, held = (held + data).split(b"\n")
        yield from whole


def archive_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, DataFrame, str]:
    """Archives `pages` (page_id, url, html); returns (records read back, manifest of the archives, their folder).

    One record a row: a null html is an empty payload, a null url an empty target, a null page_id an empty field. Rows
    that repeat a page_id keep a record each. Of equal payloads of at least min_bytes the largest page_id is the
    response and the others revisit it; rows of that same id are all responses, as are rows without an id. An empty
    table gives empty results; other columns are not stored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    pages = pages.select("page_id", "url", "html")
    twins = scratch.put(revisits(pages, min_bytes).distinct(), "revisits")
    whole = scratch.put(write_archives(pages.withColumn("digest", payload_digest()).join(twins, ["page_id", "digest"], "left"), scratch.path("whole"), archive_bytes), "whole-manifest")
    folder = scratch.path("members")
    members = scratch.put(normalise_archives(whole, folder), "manifest")
    return read_archives(members, folder), members, folder


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _, _ = archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32(hexes: str) -> str:
    """DuckDB SQL: base32 of 40 hex digits."""
    digits = f"list_transform(range(32), lambda i: substr('{BASE32}', CAST((CAST(('0x' || substr({hexes}, CAST((i // 4) * 5 + 1 AS INTEGER), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1))"
    return f"array_to_string({digits}, '')"


def oracle() -> str:
    return f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_base32('sha1(body)')} AS payload_digest,
            CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < head THEN head END AS refers_to
        FROM p"""
