"""Boxes against images, by trying all pairs."""

import random

import pytest

from tessera.operators.boxes import overlaps, tiles_in_boxes

RECT = "x0 double, y0 double, x1 double, y1 double"


def rectangles(rng, n, far):
    out = []
    for k in range(n):
        x, y, side = rng.uniform(-far, far), rng.uniform(-far, far), rng.choice([0.01, 1, 5, 40, 2 * far]) * rng.uniform(0.5, 1.5)
        out.append((k, x, y, x + side, y + side * rng.uniform(0.2, 2)))
    # On a grid, with common edges; a point, turned round, not a number, infinite, null, twice, twice with one id.
    out += [(n + k, 10.0 * k, 0.0, 10.0 * k + 10, 10.0) for k in range(5)]
    odd = [(3.0, 3.0, 3.0, 4.0), (5.0, 5.0, 4.0, 6.0), (float("nan"), 0.0, 1.0, 1.0), (0.0, 0.0, float("inf"), 1.0), (None, 0.0, 1.0, 1.0), (1.0, 1.0, 9.0, 9.0), (1.0, 1.0, 9.0, 9.0)]
    out += [(n + 5 + min(k, 5), *r) for k, r in enumerate(odd)]
    return [*out, (n + 10, 7.0, 2.0, 8.0, 30.0)]


def sane(r):
    return all(v is not None and abs(v) < float("inf") for v in r[1:]) and r[1] < r[3] and r[2] < r[4]


@pytest.mark.parametrize("far,salts", [(50, 8), (2000, 1), (3, 4)])
def test_pairs(spark, far, salts):
    rng = random.Random(far)
    boxes, images = rectangles(rng, 90, far), rectangles(rng, 120, far)
    want = []
    for b in set(filter(sane, boxes)):
        for i in set(filter(sane, images)):
            part = (max(b[1], i[1]), max(b[2], i[2]), min(b[3], i[3]), min(b[4], i[4]))
            if part[0] < part[2] and part[1] < part[3]:
                want.append((b[0], i[0], *part))
    got = [tuple(r) for r in overlaps(spark.createDataFrame([(*r, "c") for r in boxes], f"box_id long, {RECT}, m string"), spark.createDataFrame(images, f"image_id long, {RECT}"), salts).collect()]
    assert sorted(got) == sorted(want) and len(want) > 200


def test_tiles(spark):
    images = [(1, 0.0, 0.0, 1000.0, 500.0, 2000, 1000, 256), (2, 1000.0, 0.0, 1100.0, 100.0, 50, 50, 256), (3, 5000.0, 5000.0, 5001.0, 5001.0, 9, 9, 4)]
    boxes = [(10, 0.0, 0.0, 128.0, 128.0), (11, 127.0, 100.0, 129.0, 300.0), (12, 990.0, 490.0, 3000.0, 3000.0), (13, -5.0, -5.0, 9000.0, 9000.0), (14, 2000.0, 0.0, 2001.0, 1.0)]
    rows = tiles_in_boxes(spark.createDataFrame(boxes, f"box_id long, {RECT}"), spark.createDataFrame(images, f"image_id long, {RECT}, width int, height int, tile_size int")).collect()
    got = {}
    for r in rows:
        got.setdefault((r.box_id, r.image_id), set()).add((r.x, r.y))
    every = {(x, y) for x in range(8) for y in range(4)}
    assert got == {(10, 1): {(0, 0)}, (11, 1): {(0, 0), (1, 0), (0, 1), (1, 1), (0, 2), (1, 2)}, (12, 1): {(7, 3)}, (13, 1): every, (13, 2): {(0, 0)}, (13, 3): {(x, y) for x in range(3) for y in range(3)}}
    assert len(rows) == sum(map(len, got.values()))


def test_nothing(spark):
    some, none = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], f"box_id long, {RECT}"), spark.createDataFrame([], f"image_id long, {RECT}")
    assert overlaps(some, none).count() == 0 and overlaps(some.limit(0), none).columns == ["box_id", "image_id", "x0", "y0", "x1", "y1"]
    assert overlaps(some.limit(0), none).count() == 0
