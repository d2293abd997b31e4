"""Strips of one-coloured tiles alone are runs of equal rows, of which one is painted; the pixels are those of a raster."""

import hashlib

import numpy as np

from tessera.operators import mosaic
from tessera.plans import queries as q

SCHEMA = "image_id long, width int, height int, px int, py int, tile_w int, tile_h int, data binary"


def raster(width, height, tiles):
    canvas = np.zeros((height, width, 3), np.uint8)
    for _, _, _, x, y, w, h, data in sorted(tiles, key=lambda t: (t[4], t[3])):
        if data is None or w is None:
            continue
        pixels = np.frombuffer(data, np.uint8)
        pixels = np.broadcast_to(pixels, (h, w, 3)) if len(pixels) == 3 else pixels.reshape(h, w, 3)
        part = canvas[y : y + h, x : x + w]
        part[:] = pixels[: part.shape[0], : part.shape[1]]
    return canvas


def some_images():
    """One-coloured tiles over each other, beyond the edges, of no size and of no data; from image 6 on some have pixels."""
    rng, out = np.random.default_rng(7), {}
    for k in range(12):
        width, height = (int(v) for v in rng.integers(1, 90, 2))
        tiles = []
        for n in range(int(rng.integers(1, 30))):
            x, y, w, h = (int(v) for v in (rng.integers(0, width + 5), rng.integers(0, height + 5), rng.integers(0, 40), rng.integers(0, 40)))
            pixels = k > 5 and n % 4 == 1 and w * h > 1
            data = rng.integers(0, 256, 3 * w * h if pixels else 3, dtype=np.uint8).tobytes()
            tiles.append((k, width, height, x, y, None if n == 5 else w, h, None if n == 7 else data))
        at = {(t[4], t[3]): t for t in tiles}  # places differ, so the order is told
        out[k] = width, height, list(at.values())
    return out


def test_strips_are_those_of_a_raster(spark):
    images = some_images()
    tiles = spark.createDataFrame([t for _, _, ts in images.values() for t in ts], SCHEMA)
    want = {k: raster(*of) for k, of in images.items()}
    for strip in (8, 16, None):
        data = mosaic.mosaic(tiles, strip=strip).collect()
        sums = {(r.image_id, r.strip): (r.width, r.height, r.top, r.full_height, r.checksum) for r in mosaic.mosaic(tiles, strip=strip, digest=True).collect()}
        assert len(data) == len(sums)
        inside = [r for r in data if r.top < r.full_height]
        assert {r.image_id for r in inside} <= set(want) and len(inside) > 6
        for r in inside:
            part = want[r.image_id][r.top : r.top + r.height]
            assert bytes(r.data) == part.tobytes(), (strip, r.image_id, r.strip)
            assert sums[r.image_id, r.strip] == (*part.shape[1::-1], r.top, len(want[r.image_id]), hashlib.sha256(part.tobytes()).hexdigest())


def test_a_colour_that_begins_like_a_jpeg_is_painted(spark):
    """mosaic_checksum's image 540,866 has such a tile, which was left black."""
    tiles = spark.createDataFrame([(1, 2, 2, 0, 0, 2, 2, b"\xff\xd8\xff")], SCHEMA)
    assert bytes(mosaic.mosaic(tiles).first().data) == b"\xff\xd8\xff" * 4
    assert mosaic.pixels_of(b"\xff\xd8\xff", 2, 2).tobytes() == b"\xff\xd8\xff" * 4


def test_rows_of_a_run_are_painted_once():
    """An image of 12 million pixels in 16 x 12 tiles over each other by a pixel: a few dozen rows instead of 3,063."""
    tiles = [(max(0, x - 1), min(x + 256, 4063), max(0, y - 1), min(y + 256, 3063), bytes([x // 256, y // 256, 9])) for y in range(0, 3063, 256) for x in range(0, 4063, 256)]
    found = list(mosaic.runs(4063, 3063, tiles))
    assert len(found) <= 3 * 12 and sum(n for _, n in found) == 3063
    canvas = raster(4063, 3063, [(1, 4063, 3063, x0, y0, x1 - x0, y1 - y0, c) for x0, x1, y0, y1, c in tiles])
    assert mosaic.hashed(iter(found)) == hashlib.sha256(canvas).hexdigest()
    assert mosaic.hashed(iter([])) == mosaic.hashed(mosaic.runs(0, 5, [])) == hashlib.sha256(b"").hexdigest()


def test_tiles_of_a_small_table_are_made_by_many_tasks(spark):
    """The images of a table that one task reads are dealt out before their tiles are made."""
    plan = q.queries()["mosaic_checksum"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("RepartitionByExpression [image_id") > plan.rindex("Generate explode")


def test_tasks_are_whole_waves(spark):
    """With 4 cores and 4 partitions 8 tasks; partitions that aren't a multiple of the cores are rounded up to one."""
    assert mosaic.tasks_of(spark) == 8
    for partitions, tasks in ((9, 12), (12, 12), (13, 16)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert mosaic.tasks_of(spark) == tasks
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
