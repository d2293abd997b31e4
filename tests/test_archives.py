"""Crawl archives as a source, batch and stream, and redirects between their documents."""

import gzip

import pytest
from pyspark.sql import functions as F

from tessera.sources import archives
from tessera.sources.archives import CrawlArchives, followed, inflated, records

SITE = "http://arc.example"


def record(url, body, status=200, kind="response", **headers):
    head = f"HTTP/1.1 {status} Reason\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = head.encode() + body
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


RECORDS = [
    record("", b"software: x", kind="warcinfo"), record(f"{SITE}/a", "<p>ü</p>".encode(), Content_Type="text/html"), record(f"{SITE}/busy", b"later", 429), record(f"{SITE}/gone", b"still a page", 404, Set_Cookie="k=1"),
    record(f"{SITE}/to", b"", 302, Location="/a"), record(f"{SITE}/a", b"q", kind="request"), record(f"{SITE}/long", b"x" * 3_000_000 + b"\r\n\r\nWARC/1.1\r\n"), record(f"{SITE}/raw", b"\xff\xfe"),
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "crawl").mkdir()
    (tmp_path / "crawl/one.warc.gz").write_bytes(b"".join(map(gzip.compress, RECORDS[:4])))
    (tmp_path / "crawl/two.warc.gz").write_bytes(gzip.compress(b"".join(RECORDS[4:6])))  # one member for several records
    (tmp_path / "crawl/three.warc").write_bytes(b"".join(RECORDS[6:]) + RECORDS[1][:60])  # the last record is cut off
    (tmp_path / "crawl/_part.warc").write_bytes(RECORDS[1])
    (tmp_path / "crawl/note.txt").write_bytes(b"no archive")
    return str(tmp_path / "crawl")


def test_archives_are_read(spark, folder):
    spark.dataSource.register(CrawlArchives)
    rows = {r.url: r for r in spark.read.format("crawl_archives").load(folder).collect()}
    assert sorted(u[len(SITE) :] for u in rows) == ["/a", "/busy", "/gone", "/long", "/raw", "/to"]
    assert (rows[f"{SITE}/a"].body, rows[f"{SITE}/a"].content_type, rows[f"{SITE}/a"].status) == ("<p>ü</p>", "text/html", 200)
    assert rows[f"{SITE}/busy"].error == "HTTP 429" and rows[f"{SITE}/gone"].error is None and rows[f"{SITE}/gone"].headers == {"set-cookie": "k=1"}
    assert rows[f"{SITE}/to"].location == "/a" and len(rows[f"{SITE}/long"].body) == 3_000_014 and rows[f"{SITE}/raw"].body == "��"
    assert spark.read.format("crawl_archives").load(folder + "/none").count() == 0


def test_filters_are_pushed(spark, folder):
    spark.dataSource.register(CrawlArchives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        docs = spark.read.format("crawl_archives").option("push", "true").load(folder)
        for condition, want in ((F.col("url") == f"{SITE}/a", 1), (F.col("status").isin(429, 404), 2), (F.col("url").startswith(f"{SITE}/g"), 1), ((F.col("status") == 200) & F.col("body").contains("x"), 1), (F.col("status") > 400, 2)):
            found = docs.filter(condition)
            assert found.count() == want
        reader = archives.FilteringReader(folder)
        from pyspark.sql.datasource import EqualTo, GreaterThan

        rest = list(reader.pushFilters([EqualTo(("status",), 200), GreaterThan(("status",), 1), EqualTo(("body",), "x")]))
        assert len(rest) == 2 and len(reader.filters) == 1
        assert [r[0] for p in reader.partitions() for r in reader.read(p) if r[0].endswith("/a")] == [f"{SITE}/a"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_archives_as_a_stream(spark, folder, tmp_path):
    spark.dataSource.register(CrawlArchives)

    def run():
        query = spark.readStream.format("crawl_archives").load(folder).select("url", "status").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return sorted(r.url[len(SITE) :] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["/a", "/busy", "/gone", "/long", "/raw", "/to"]
    with open(folder + "/zz.warc", "wb") as f:
        f.write(record(f"{SITE}/new", b"n"))
    assert run() == ["/a", "/busy", "/gone", "/long", "/new", "/raw", "/to"] == run()


@pytest.mark.parametrize("size", [1, 7, 1000, 10**7])
def test_records_of_any_pieces(size):
    for data in (b"".join(RECORDS), gzip.compress(b"".join(RECORDS)), b"".join(map(gzip.compress, RECORDS))):
        if size == 1 and len(data) > 10**6:
            continue
        pieces = iter([data[k : k + size] for k in range(0, len(data), size)])
        found = [(h["warc-type"], len(b)) for h, b in records(inflated(pieces))]
        assert len(found) == 8 and found[0][0] == "warcinfo" and found[6][1] > 3_000_000
    assert list(records(inflated(iter([])))) == []


def test_redirects(spark):
    chain = [(f"{SITE}/{k}", f"/{k + 1}", f"b{k}") for k in range(6)] + [(f"{SITE}/6", None, "end"), (f"{SITE}/lost", "nowhere", "x"), (f"{SITE}/p", "/q", "p"), (f"{SITE}/q", "/p", "q"), (f"{SITE}/same", "/same", "s"), (f"{SITE}/6", "/0", "later"), (None, "/6", "n"), (f"{SITE}/null", None, None)]
    rows = {r.url[len(SITE) + 1 :]: (r.final_url and r.final_url[len(SITE) + 1 :], r.hops, r.body, r.disabled_location and r.disabled_location[len(SITE) + 1 :], r.needs_url and r.needs_url[len(SITE) + 1 :]) for r in followed(spark.createDataFrame(chain, "url string, location string, body string")).collect()}
    assert rows == {
        "0": ("3", 3, "b3", "4", None), "1": ("4", 3, "b4", "5", None), "2": ("5", 3, "b5", "6", None), "3": ("6", 3, "end", None, None), "4": ("6", 2, "end", None, None), "5": ("6", 1, "end", None, None), "6": ("6", 0, "end", None, None),
        "lost": ("lost", 0, None, None, "nowhere"), "p": ("q", 3, "q", "p", None), "q": ("p", 3, "p", "q", None), "same": ("same", 3, "s", "same", None), "null": ("null", 0, None, None, None),
    }
    assert followed(spark.createDataFrame([], "url string, location string, body string")).count() == 0
