import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import grid
from tessera.operators.mosaic import mosaic, progress, scaled_places
from tessera.sources.documents import fetch


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw,out", [("a&amp;lt;b", "a&lt;b"), ("&AMP;&#65;&#x42;", "&AB"), ("&apos;&nbsp;", "&apos;&nbsp;"), ("", ""), ("x&quot;", 'x"'), ("&#65601;", "A")])
def test_entities(spark, raw, out):
    assert one(spark, t.decode_entities(F.lit(raw))) == out


@pytest.mark.parametrize("path,base,out", [
    ("http://a/b", "http://h/x", "http://a/b"), ("//a/b", "https://h/x", "https://a/b"), ("//a/b", "h", "http://a/b"), ("/r", "http://h/a/b", "http://h/r"), ("n", "http://h/a/b", "http://h/a/n"),
    ("../n", "http://h/a/b/c", "http://h/a/n"), ("../../n", "http://h/a/b/c", "http://h/n"), ("./n", "http://h/a/b", "http://h/a/./n"), ("/x", "http://h", "http:/x"), ("q?u=http://z", "http://h/a", "q?u=http://z"),
])
def test_resolve_relative(spark, path, base, out):
    assert one(spark, t.resolve_relative(F.lit(path), F.lit(base))) == out


@pytest.mark.parametrize("x,out", [(0.75, "0.75"), (1.0, "1"), (0.0, "0"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (0.00012, "0.00012"), (123456789.5, "123456789.5"), (1 / 3, "0.3333333333333333"), (-0.5, "-0.5"), (1e21, "1e+21"), (12345678.25, "12345678.25")])
def test_js_numbers(spark, x, out):
    assert one(spark, t.js_number(F.lit(x))) == out


def test_numbers_and_padding(spark):
    assert one(spark, t.parse_int(F.lit(" 512px"))) == 512 and one(spark, t.parse_int(F.lit("px"))) is None
    assert one(spark, t.to_int32(F.lit("12x"))) == 0 and one(spark, t.to_int32(F.lit("12"))) == 12
    assert one(spark, t.pad_left(F.lit("1234"), 3, "0")) == "1234" and one(spark, t.pad_left(F.lit("7"), 3, "0")) == "007"
    assert one(spark, t.encode_uri_component(F.lit("a b/ü!'()*~"))) == "a%20b%2F%C3%BC!'()*~"
    assert one(spark, t.encode_uri(F.lit("http://h/a b?x=ü&y#z"))) == "http://h/a%20b?x=%C3%BC&y#z"
    assert one(spark, t.find_max_zoom(F.lit(100), F.lit(100), F.lit(256))) == -1
    assert [one(spark, t.is_private_ipv4(F.lit(h))) for h in ("10.1.1.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "127.0.0.1", "h")] == [True, True, False, True, False, False]


def test_level_choice_ties(spark):
    levels = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(n).alias("n")) for w, n in ((1, "a"), (5, "b"), (5, "c"), (2, "d"))])
    assert one(spark, grid.arg_max(levels, lambda v: v["width"])).n == "b" and one(spark, grid.arg_max(levels, lambda v: v["width"], last=True)).n == "c"
    assert one(spark, grid.arg_min(levels, lambda v: v["width"])).n == "a"


def test_tiles_cover_the_image(spark):
    images = spark.createDataFrame([(k, 1 + k * 397 % 3000, 1 + k * 211 % 2000, 256) for k in range(40)] + [(99, 0, 10, 256)], "image_id int, width int, height int, tile_size int")
    w, h = grid.crops(F.col("width"), F.col("height"), F.col("x"), F.col("y"), F.col("tile_size"))
    sums = grid.plan_tiles(images).groupBy("image_id", "width", "height").agg(F.sum(w * h).alias("area"), F.countDistinct("tile_index").alias("n"), F.max("tile_index").alias("last")).collect()
    assert len(sums) == 40 and all(r.area == r.width * r.height and r.n == r.last + 1 for r in sums)


def test_box_reaches_the_generator(spark):
    plan = grid.plan_tiles(spark.createDataFrame([(1, 5000, 5000, 256)], "image_id int, width int, height int, tile_size int"), (2, 3, 4, 6))
    assert sorted((r.x, r.y) for r in plan.collect()) == [(x, y) for x in (2, 3) for y in (3, 4, 5)]


def test_mosaic_order_and_strips(spark):
    tile = lambda c, w, h: bytearray(np.full((h, w, 3), c, np.uint8).tobytes())
    rows = [(1, 4, 6, 0, 0, 3, 4, tile(10, 3, 4)), (1, 4, 6, 2, 0, 2, 4, tile(20, 2, 4)), (1, 4, 6, 0, 3, 4, 3, tile(30, 4, 3))]
    tiles = spark.createDataFrame(rows, "image_id long, width int, height int, px int, py int, tile_w int, tile_h int, data binary")
    strips = mosaic(tiles, strip=4).orderBy("strip").collect()
    canvas = np.concatenate([np.frombuffer(s.data, np.uint8).reshape(s.height, s.width, 3) for s in strips])[:, :, 0]
    assert canvas.tolist() == [[10, 10, 20, 20]] * 3 + [[30] * 4] * 3
    placed = scaled_places(tiles).select("ratio", "dw").first()
    assert placed.ratio == 1.0 and placed.dw == 3


def test_progress(spark):
    images = spark.createDataFrame([(1, 2), (2, 1)], "image_id long, total_tiles long")
    results = spark.createDataFrame([(1, 1, "ok", None), (1, 3, "bad", "late"), (1, 2, "bad", "first"), (1, 4, "ok", None)], "image_id long, seq int, status string, error string")
    rows = {r.image_id: r for r in progress(images, results).collect()}
    assert (rows[1].loaded, rows[1].failed, rows[1].done, rows[1].first_error) == (2, 2, True, "first") and not rows[2].done


def test_fetch_is_off_and_retries(spark):
    requests = spark.createDataFrame([("http://h/a",), ("http://h/b",)], "url string")
    with pytest.raises(RuntimeError):
        fetch(requests)

    def get(url):
        if url.endswith("b"):
            raise OSError("no")
        return 200, "text/plain", url.encode()

    rows = {r.url: r for r in fetch(requests, get, per_second=1000, attempts=3, enabled=True).collect()}
    assert rows["http://h/a"].attempts == 1 and bytes(rows["http://h/a"].data) == b"http://h/a"
    assert rows["http://h/b"].attempts == 3 and rows["http://h/b"].error == "no"


def test_mosaic_checksum_paints_every_image(spark):
    import hashlib

    from tessera.plans.queries import images, mosaic_checksum

    sf = "/root/testdata/sf0.001"
    got = {(r.image_id, r.strip): (r.width, r.height, r.checksum) for r in mosaic_checksum(spark, sf).collect()}
    rows = images(spark, sf).collect()
    assert set(got) == {(r.image_id, 0) for r in rows}  # no image is higher than a strip
    for r in sorted(rows, key=lambda r: -r.width * r.height)[:3] + sorted(rows, key=lambda r: r.width * r.height)[:20]:
        canvas, k = np.zeros((r.height, r.width, 3), np.uint8), 0
        for y in range(0, r.height, 256):
            for x in range(0, r.width, 256):
                px, py = max(0, x - 1), max(0, y - 1)
                canvas[py : y + 256, px : x + 256] = list((r.image_id * 31 + k * 7).to_bytes(3, "big"))
                k += 1
        assert got[r.image_id, 0] == (r.width, r.height, hashlib.sha256(canvas).hexdigest())
