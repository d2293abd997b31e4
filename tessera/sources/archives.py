"""Crawl archives as a Spark source, in batches and as a stream, and the redirects between their documents.

spark.dataSource.register(CrawlArchives); spark.read.format("crawl_archives").load(folder) has a row for each response
record of the WARC files of a folder. A partition is a file, read record by record. With option("push", "true"), in sessions where
spark.sql.python.filterPushdown.enabled is set, what a filter on url or status rules out is skipped before its body is
decoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from tessera.functions.text import resolve_relative
from tessera.sources.shared import Written, meet, shuffled

SCHEMA = "url string, status int, content_type string, location string, headers map<string,string>, body string, error string"
#: Redirects that are followed; bytes that are read of a file at once.
REDIRECTS, CHUNK = 3, 1 << 20


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, or of a plain file, in pieces of bounded size."""
    first = b""
    while len(first) < 2 and (piece := next(chunks, b"")):
        first += piece
    if first[:2] != b"\x1f\x8b":
        yield first
        yield from chunks
        return
    member, data = zlib.decompressobj(31), first
    while True:
        while data:
            out = member.decompress(data, CHUNK)
            if out:
                yield out
            data = member.unconsumed_tail
            if member.eof:
                data, member = member.unused_data, zlib.decompressobj(31)
        data = next(chunks, b"")
        if not data:
            return


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with names in small letters, block) of each record of a WARC stream. A record that is cut off ends it."""
    held = bytearray()

    def more() -> bool:
        piece = next(chunks, b"")
        held.extend(piece)
        return bool(piece)

    while True:
        end = -1
        while end < 0:
            while held[:1] in (b"\r", b"\n"):
                del held[:1]
            end = held.find(b"\r\n\r\n")
            if end < 0 and not more():
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else 0
        while len(held) < end + 4 + size:
            if not more():
                return
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def response(headers: dict[str, str], block: bytes, wanted=lambda url, status: True) -> tuple | None:
    """A row of SCHEMA for a response record; None for other records and for those that nobody wants.

    A redirect's location is absolute. Bodies are text in UTF-8, with marks for what is none. Of statuses only 500 and 429 are errors.
    """
    if headers.get("warc-type") != "response":
        return None
    url = headers.get("warc-target-uri", "").strip("<>")
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    words = lines[0].split(" ", 2)
    status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
    if not wanted(url, status):
        return None
    own: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        own.setdefault(name.strip().lower(), value.strip())
    error = f"HTTP {status}" if status in (500, 429) else None
    return url, status, own.get("content-type"), own.get("location"), own, body.decode("utf-8", "replace"), error


@dataclass
class ArchiveFile(InputPartition):
    path: str


def _files(folder: str) -> list[str]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith((".", "_")))


def _rows(folder: str, path: str, filters: list[Filter]) -> Iterator[tuple]:
    from pyarrow import fs

    def wanted(url: str, status: int | None) -> bool:
        for f in filters:
            value = {"url": url, "status": status}[f.attribute[0]]
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    store, _ = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    with store.open_input_stream(path, compression=None) as file:
        for headers, block in records(inflated(iter(lambda: file.read(CHUNK), b""))):
            row = response(headers, block, wanted)
            if row is not None:
                yield row


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.filters = folder, []

    def partitions(self) -> list[InputPartition]:
        return [ArchiveFile(p) for p in _files(self.folder)] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        if partition.path:
            yield from _rows(self.folder, partition.path, self.filters)


class FilteringReader(ArchiveReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over equality, lists and beginnings of url and status; yields the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (("url",), ("status",)):
                self.filters.append(f)
            else:
                yield f


class ArchiveStream(DataSourceStreamReader):
    """Files by name, each once; names of later files sort after those of earlier ones, as crawlers number them."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(_files(self.folder), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [ArchiveFile(p) for p in _files(self.folder) if start["after"] < p <= end["after"]]

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        yield from _rows(self.folder, partition.path, [])

    def commit(self, end: dict) -> None:
        pass


class CrawlArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        push = self.options.get("push", "false").lower() == "true"
        return (FilteringReader if push else ArchiveReader)(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArchiveStream(self.options["path"])


def followed(documents: DataFrame, redirects: int = REDIRECTS) -> DataFrame:
    """(url, final_url, hops, body, disabled_location, needs_url): where each URL of documents (url, location, body) leads.

    Up to `redirects` redirects are followed. One that is left over is not: its target is in disabled_location, and the
    body is that of the answer that names it; so end redirects that lead round. A redirect to what isn't in the crawl has
    its target in needs_url and no body. Of documents that repeat a URL those without a location go first, then the least
    (location, body) counts. Null URLs are left out, null bodies stay so. No documents give no rows.

    The chains are joined as URLs alone, however many lead to one; bodies are joined once, at the end.
    """
    tables = Written(documents.sparkSession, "redirects")
    target = resolve_relative(F.col("location"), F.col("url"))
    answer = F.struct(F.col("location").isNotNull().alias("moved"), target.alias("to"), F.col("body").alias("body"))
    one = tables.put(documents.filter("url is not null").groupBy("url").agg(F.min(answer).alias("a")).select("url", "a.to", "a.body"), "answers")
    links = one.select(F.col("url").alias("to"), F.col("to").alias("next"), F.lit(True).alias("known"))
    none = F.lit(None).cast("string")
    chain = one.select("url", F.col("url").alias("at"), "to", F.lit(0).alias("hops"), none.alias("lost"))
    for _ in range(redirects):
        step = meet(chain, links, ["to"], ["url"])
        known, moved = F.coalesce("known", F.lit(False)), F.col("to").isNotNull()
        chain = step.select("url", F.when(known, F.col("to")).otherwise(F.col("at")).alias("at"), F.when(known, F.col("next")).alias("to"), (F.col("hops") + known.cast("int")).alias("hops"), F.coalesce("lost", F.when(moved & ~known, F.col("to"))).alias("lost"))
    found = chain.join(shuffled(one.select(F.col("url").alias("at"), "body")), "at")
    return found.select("url", F.col("at").alias("final_url"), "hops", F.when(F.col("lost").isNull(), F.col("body")).alias("body"), F.col("to").alias("disabled_location"), F.col("lost").alias("needs_url"))
