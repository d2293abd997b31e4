"""Pacing, retries, the search of grids, keyed progress and signing, against plain versions."""

import base64
import collections
import datetime
import hashlib
import hmac
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import grid, tileurl
from tessera.operators.search import search_grids
from tessera.sources.documents import fetch
from tessera.sources.pacing import BROWSER, TOOL, schedule
from tessera.streaming import progress


def test_schedule_of_a_hot_host(spark):
    urls = [(f"http://big.example/{k}",) for k in range(500)] * 2 + [("http://one.example/a b",), ("http://ONE.example/c",), (None,), ("no host",)]
    rows = schedule(spark.createDataFrame(urls, "url string"), per_second=10, lanes=7).collect()
    by_host = collections.defaultdict(list)
    for r in rows:
        by_host[r.host].append(r)
    assert {h: len(v) for h, v in by_host.items()} == {"big.example": 500, "one.example": 2, "": 1}
    for own in by_host.values():
        assert sorted(r.place for r in own) == list(range(len(own))) and all(r.due == r.place / 10 and r.lane == r.place % r.lanes and r.lanes == min(7, len(own)) for r in own)
    assert sorted(collections.Counter(r.lane for r in by_host["big.example"]).values()) == [71] * 4 + [72] * 3
    assert "http://one.example/a%20b" in {r.url for r in rows}
    assert schedule(spark.createDataFrame([], "url string")).count() == 0


def test_a_host_keeps_its_rate_over_many_tasks(spark):
    def get(url):
        import os

        return 200, str(os.getpid()), repr(time.time()).encode()

    requests = spark.createDataFrame([(f"http://big.example/{k}",) for k in range(60)], "url string")
    rows = fetch(requests, get, per_second=30, lanes=4, enabled=True).collect()
    times = sorted(float(r.data) for r in rows)
    assert len(rows) == 60 and len({r.content_type for r in rows}) > 1
    assert times[-1] - times[0] >= 1.5
    for a, at in enumerate(times):  # in no half second more than the rate and one of each lane
        assert sum(at <= t < at + 0.5 for t in times[a:]) <= 15 + 4


def test_policies_wait_as_the_page_and_the_tool_do():
    assert [BROWSER.wait(n, 0.5) for n in range(1, 6)] == [1, 5, 25, 125, 625] and BROWSER.attempts == 6
    assert [TOOL.wait(n, 0.9) for n in range(1, 11)] == [2**k for k in range(10)] and TOOL.attempts == 11


def test_tries_by_policy(spark):
    def get(url):
        if url.endswith("never"):
            raise OSError("no")
        return (500 if url.endswith("busy") else 404), "text/plain", b"x"

    requests = spark.createDataFrame([("http://a/never",), ("http://b/busy",), ("http://c/gone",)], "url string")
    rows = {r.url[-5:]: r for r in fetch(requests, get, per_second=5000, enabled=True, policy=TOOL).collect()}
    assert (rows["never"].attempts, rows["never"].error) == (11, "no") and (rows["/busy"].attempts, rows["/busy"].error) == (11, "HTTP 500")
    assert (rows["/gone"].attempts, rows["/gone"].status, rows["/gone"].error) == (1, 404, None)


# The search of grids


def bisected(exists, sizes, most):
    """Plainly, one image and one side after the other."""
    ends, tile, probes = [[0, most], [0, most]], 256, []
    for side in (0, 1):
        while ends[side][0] + 1 < ends[side][1]:
            middle = sum(ends[side]) // 2
            at = (middle, 0) if side == 0 else (0, middle)
            ok = exists(*at)
            ends[side][0 if ok else 1] = middle
            probes.append(at)
            if ok and not (side == 1 and ends[1][0] + 1 == ends[1][1]):
                tile = max(tile, min(sizes(*at)))
    return ends[0][1] * tile, ends[1][1] * tile, tile


@pytest.mark.parametrize("most", [1000, 13])
def test_grids_as_a_plain_search_finds_them(spark, most):
    """Also grids with holes, of one tile or none, and of as many as are looked for."""
    import random

    rng = random.Random(3)
    images = {k: (rng.randrange(0, most + 40), rng.randrange(0, most + 40), rng.choice([100, 300, 512]), rng.random() < 0.2) for k in range(40)} | {40: (0, 0, 300, False), 41: (1, 1, 300, False), 42: (2, 3, 300, False)}

    def exists(k, x, y):
        w, h, _, holes = images[k]
        return x < w and y < h and not (holes and (x * 7 + y * 3 + k) % 5 == 0)

    def sizes(k, x, y):
        w, h, side, _ = images[k]
        return (side if x < w - 1 else 40), (side if y < h - 1 else 270)

    def probe(urls):
        rows = []
        for r in urls.collect():
            k, x, y = map(int, r.url.split("/")[-3:])
            rows.append((r.url, exists(k, x, y), *sizes(k, x, y)))
        return spark.createDataFrame(rows, "url string, ok boolean, width int, height int")

    requests = spark.createDataFrame([(k, f"http://h/{k}/{{{{x}}}}/{{{{Y}}}}") for k in images] + [(99, None), (7, "http://h/7/{{x}}/{{Y}}")], "request_id long, url string")
    rows = search_grids(requests, probe, most).collect()
    assert len(rows) == len(images) + 2 and [r.error for r in rows if r.request_id == 99] == ["There is no template."]
    for r in rows:
        if r.request_id != 99:
            k = r.request_id
            assert (r.width, r.height, r.tile_size) == bisected(lambda x, y, k=k: exists(k, x, y), lambda x, y, k=k: sizes(k, x, y), most), k
    assert max(r.rounds or 0 for r in rows) <= 10


def test_a_found_grid_is_planned(spark):
    requests = spark.createDataFrame([(1, "http://h/{{X:_2}}/{{y}}.png")], "request_id long, url string")
    probe = lambda urls: urls.select("url", F.regexp_extract("url", r"/_(\d)/([01])\.png", 1).isin("0", "1", "2").alias("ok"), F.lit(300).alias("width"), F.lit(310).alias("height"))
    tiles = tileurl.with_tile_urls(grid.plan_tiles(search_grids(requests, probe, 50)), ["Generic"]).orderBy("tile_index").collect()
    assert [t.url for t in tiles] == [f"http://h/_{x}/{y}.png" for y in range(2) for x in range(3)] and tiles[-1].px == 600
    assert search_grids(requests.limit(0), probe).count() == 0


# Keyed progress

ROWS = "ts timestamp, image_id long, total_tiles long, seq long, status string, error string"
START = datetime.datetime(2024, 5, 1, 12, 0)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_progress_of_images_as_state(spark, tmp_path):
    for k, v in progress.STATE_STORE.items():
        spark.conf.set(k, v)

    def run(rows):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = progress.progress_events(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), expire_ms=100_000)
        query = events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        found = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.image_id, (r.at - START).total_seconds(), r.kind, r.loaded, r.failed, r.total, r.percent, r.first_error) for r in found)

    plan = lambda t, k, n: (at(t), k, n, None, None, None)
    tile = lambda t, k, seq, error=None: (at(t), k, None, seq, "error" if error else "ok", error)
    try:
        first = run([plan(0, 1, 3), tile(0.1, 1, 5), tile(0.2, 1, 4, "later"), tile(0.3, 1, 2, "first"), plan(0.6, 2, 2), tile(0.7, 2, 0), tile(0.8, 2, 1), plan(0.9, 2, 77)])
        # Image 2 is done at once; the watermark hasn't reached image 1's tick.
        assert first == [(2, 0.9, "done", 2, 0, 2, 100, None)]
        second = run([plan(30, 3, 1)])
        assert second[0] == (1, 0.5, "progress", 1, 2, 3, 33, "first") and second[1:] == first + [(3, 30.5, "progress", 0, 0, 1, 0, None)] or second == sorted(first + [(1, 0.5, "progress", 1, 2, 3, 33, "first")])
        third = run([tile(31, 1, 7), tile(31, 1, 8), tile(31.2, 2, 9, "too late to matter"), plan(31.4, 2, 9)])
        assert (1, 31.0, "done", 3, 2, 3, 100, "first") in third and sum(r[0] == 2 for r in third) == 1
        last = run([plan(400, 4, 1)])
        # Nothing came for image 3 for long; images that are done are dropped without a word.
        assert [r for r in last if r[2] == "given up"] == [(3, 130.0, "given up", 0, 0, 1, 0, None)]
        assert sum(r[2] == "done" for r in last) == 2
    finally:
        for k in progress.STATE_STORE:
            spark.conf.unset(k)


# Signing


def test_hmac_of_columns(spark):
    texts = ["", "a", "x" * 200, "Grüße 日本"]
    for key in (b"", b"k", b"x" * 64, b"long " * 40, bytes(range(256))):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tileurl.hmac_sha1(key, F.col("t")).alias("m")).collect()
        assert all(bytes(r.m) == hmac.new(key, r.t.encode(), hashlib.sha1).digest() for r in rows)


def test_signed_formats_from_page_to_tile(spark):
    from tessera.plans import crawl

    site = "https://lh.example"
    info = '<TileInfo tile_width="100" tile_height="100"><pyramid_level num_tiles_x="1" num_tiles_y="1" empty_pels_x="0" empty_pels_y="0"/><pyramid_level num_tiles_x="2" num_tiles_y="1" empty_pels_x="30" empty_pels_y="0"/></TileInfo>'
    held = [("https://artsandculture.google.com/a", '["x"],"//lh.example/abc-1","tok/9"'), ("https://artsandculture.google.com/b", '["x"],"//lh.example/dir/b2",null'), (f"{site}/abc-1=g", info), (f"{site}/dir/b2=g", info), ("https://maps.hungaricana.hu/c", "layer_url: 'https://img.example/imagesize/' imagepath = \"d.ecw\""), ("https://img.example/imagesize/d.ecw", '{"width": 700, "height": 300}')]
    formats, keys = ["Arts & Culture", "Hungaricana"], {"Arts & Culture": b"throwaway", "Hungaricana": "0123456789abcdef"}
    asked = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(held) if k in (0, 1, 4)], "request_id long, url string")
    described = crawl.describe(asked, spark.createDataFrame(held, "url string, body string"), formats)
    assert described.filter("failed_at is not null").count() == 0
    tiles = collections.defaultdict(dict)
    for t in crawl.tiles(described, formats, keys).collect():
        tiles[t.request_id][t.x, t.y] = t.url
    for k, path, token in ((0, "abc-1", "tok/9"), (1, "dir/b2", "")):
        plain = f"{path}=x1-y0-z1-t"
        mac = base64.b64encode(hmac.new(b"throwaway", (plain + token).encode(), hashlib.sha1).digest()).decode()
        assert len(tiles[k]) == 2 and tiles[k][1, 0] == f"{site}/{plain}" + mac.rstrip("=").replace("+", "_").replace("/", "_")
    assert len(tiles[4]) == 2 and all(u.startswith("https://img.example/image/d.ecw/") and len(u) == 64 for u in tiles[4].values())
    assert crawl.tiles(described, formats).filter("url is not null").count() == 0
