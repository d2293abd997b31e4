"""Crawled documents and tiles: reading a crawl table, and a paced fetcher that is off unless it is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.pacing import BROWSER, LANES, PER_SECOND, Policy, schedule

REDIRECTS = 3


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(url, status, content_type, body) of a crawl; of statuses only 500 and 429 are errors, other bodies are read as they are."""
    docs = spark.read.parquet(path)
    return docs.withColumn("error", F.when(F.col("status").isin(500, 429), F.concat(F.lit("HTTP "), F.col("status"))))


def http_get(url: str) -> tuple[int, str, bytes]:
    """Status, content type and body; an answer of any status is data, as pages behind errors may still hold an image."""
    import urllib.error
    import urllib.request

    opener = urllib.request.build_opener()
    for handler in opener.handlers:
        if isinstance(handler, urllib.request.HTTPRedirectHandler):
            handler.max_redirections = REDIRECTS
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0", "Accept": "*/*", "Referer": url})
    try:
        with opener.open(request, timeout=30) as r:
            return r.status, r.headers.get("Content-Type", ""), r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type", ""), e.read()


def fetch(requests: DataFrame, get: Callable[[str], tuple[int, str, bytes]] | None = None, per_second: float = PER_SECOND, attempts: int | None = None, enabled: bool = False, policy: Policy = BROWSER, lanes: int = LANES) -> DataFrame:
    """(url, attempts, status, content_type, data, error) for the distinct URLs of requests (url).

    Needs enabled=True. URLs go by their schedule(): a lane of a host is in one task, which asks every lanes / per_second
    seconds of its own time, so a task that starts late never hurries, and a host's lanes together keep its rate; tries
    after a failure take a turn each, and wait as the policy says, or longer. `attempts` may cut the policy's. get is
    http_get unless given, as in tests. A repeated task fetches anew.
    """
    if not enabled:
        raise RuntimeError("fetching is off; pass enabled=True")
    get = get or http_get
    most = attempts or policy.attempts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random
        import time

        start, due = time.monotonic(), {}
        for frame in frames:
            rows = []
            for host, lane, of, url in zip(frame["host"], frame["lane"], frame["lanes"], frame["url"], strict=True):
                status, kind, data, error, tried, wait = None, None, None, None, 0, 0.0
                for tried in range(1, most + 1):
                    time.sleep(max(0.0, due.get((host, lane), start + lane / per_second) - time.monotonic(), wait))
                    due[host, lane] = time.monotonic() + of / per_second
                    try:
                        status, kind, data = get(url)
                        error = f"HTTP {status}" if status in (500, 429) else None
                    except Exception as e:  # a failed request is a row, not a failed task
                        error = str(e)
                    if error is None:
                        break
                    wait = policy.wait(tried, random.random()) / 1000
                rows.append((url, tried, status, kind, data, error))
            yield pd.DataFrame(rows, columns=["url", "attempts", "status", "content_type", "data", "error"])

    # A number of its own, as tasks of few bytes would be put together, though it is their time that counts.
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = schedule(requests, per_second, lanes).repartition(tasks, "host", "lane").sortWithinPartitions("place", "host")
    return dealt.select("host", "lane", "lanes", "url").mapInPandas(run, "url string, attempts int, status int, content_type string, data binary, error string")


def write_files(images: DataFrame, folder: str) -> DataFrame:
    """Writes (name, data) as files of a folder that all executors share, given by a URI; returns (path, bytes)."""
    return write_parts(images.select("name", F.lit(0).alias("part"), "data"), folder)


def write_parts(parts: DataFrame, folder: str) -> DataFrame:
    """Writes (name, part, data) as files, a name's parts one after the other; returns (path, bytes), a row for each file.

    The folder is given by a URI and shared by all executors. A task holds a batch of parts, never a file, and writes to
    a name of its own that becomes the file's at the end, so a task that is lost or runs twice leaves no half file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        own, name, out, size = None, None, None, 0

        def done():
            out.close()
            store.move(own, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([size], pa.int64())], ["path", "bytes"])

        for batch in batches:
            for this, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if this != name:
                    if out is not None:
                        yield done()
                    own, name, size = f"{root}/.{uuid.uuid4().hex}", this, 0
                    out = store.open_output_stream(own, compression=None)
                size += out.write(data.as_py())
        if out is not None:
            yield done()

    dealt = parts.select("name", "part", "data").repartition("name").sortWithinPartitions("name", "part")
    return dealt.mapInArrow(run, "path string, bytes long")


def read_files(paths: DataFrame, folder: str) -> DataFrame:
    """(path, data) of files (path) that write_parts() has written to a folder, a batch of paths at a time.

    A task opens as many files as its rows name, so small files cost no tasks of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                own, data = batch.column(0).slice(at, 64), []
                for path in own.to_pylist():
                    with store.open_input_stream(path, compression=None) as file:
                        data.append(file.read())
                yield pa.RecordBatch.from_arrays([own, pa.array(data, pa.binary())], ["path", "data"])

    return paths.select("path").mapInArrow(run, "path string, data binary")


def write_jpegs(strips: DataFrame, folder: str, quality: int = 95) -> DataFrame:
    """Writes mosaic()'s strips as one JPEG for each image, <image_id>.jpg; returns (path, bytes).

    Strips are coded where they are, and only coded bytes travel to the task that writes a file.
    """
    from tessera.operators.mosaic import coded_strips

    coded = coded_strips(strips, quality)
    return write_parts(coded.select(F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("name"), F.col("strip").alias("part"), "data"), folder)
