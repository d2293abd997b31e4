"""JPEG against the platform's own coder, strips against whole images, painted mosaics against plain painting."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.grid import canvas_ratio
from tessera.operators.mosaic import coded_strips, mosaic, pixels_of, scaled, scaled_places, shares, with_sizes
from tessera.sources import documents, jpeg


def picture(height, width, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    waves = np.stack([x * 255 / max(width, 2), y * 255 / max(height, 2), 128 + 90 * np.sin(x / 9) * np.cos(y / 7)], axis=2)
    return np.clip(waves + rng.normal(0, 4, (height, width, 3)), 0, 255).astype(np.uint8)


def java_decoded(spark, data):
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    w, h = image.getWidth(), image.getHeight()
    flat = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255], axis=2)


def java_encoded(spark, pixels, grey=False):
    jvm = spark._jvm
    h, w = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, pixels[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


@pytest.mark.parametrize("height,width", [(1, 1), (8, 8), (17, 9), (40, 70), (7, 130)])
def test_another_decoder_reads_what_is_coded(spark, height, width):
    pixels = picture(height, width)
    data = jpeg.encode(pixels)
    theirs, ours = java_decoded(spark, data), jpeg.decode(data).astype(int)
    assert theirs.shape == ours.shape == pixels.shape and jpeg.size_of(data) == (width, height)
    assert np.abs(theirs - ours).max() <= 3 and np.abs(ours - pixels).mean() < 3


def test_what_another_coder_writes_is_read(spark):
    """It halves the resolution of colours, which makes blocks of other sizes."""
    for height, width in ((16, 16), (37, 51)):
        pixels = picture(height, width, 3)
        data = java_encoded(spark, pixels)
        theirs, ours = java_decoded(spark, data), jpeg.decode(data).astype(int)
        assert np.abs(theirs - ours).max() <= 4 and jpeg.size_of(data) == (width, height)
    grey = np.repeat(picture(20, 30, 4)[:, :, :1], 3, axis=2)
    data = java_encoded(spark, grey, grey=True)
    jvm = spark._jvm
    raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data))).getRaster()
    theirs = np.array([[raster.getSample(x, y, 0) for x in range(30)] for y in range(20)])
    assert np.abs(theirs[:, :, None] - jpeg.decode(data)).max() <= 2


@pytest.mark.parametrize("rows", [8, 24, 64, 200])
def test_strips_make_the_same_file(rows):
    pixels = picture(133, 50, 1)
    parts = [jpeg.encode_rows(pixels[a : a + rows], a // 8, a + rows >= 133) for a in range(0, 133, rows)]
    assert jpeg.header(50, 133) + b"".join(parts) + jpeg.END == jpeg.encode(pixels)
    with pytest.raises(ValueError):
        jpeg.encode_rows(pixels[:12], 0, False)


def test_qualities_and_hard_pixels():
    noise = np.random.default_rng(2).integers(0, 256, (64, 72, 3), dtype=np.uint8)
    errors = [np.abs(jpeg.decode(jpeg.encode(noise, q)).astype(int) - noise).mean() for q in (10, 50, 95, 100)]
    assert errors == sorted(errors, reverse=True) and errors[-1] < 1
    for colour in ((0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (1, 2, 254)):
        flat = np.broadcast_to(np.uint8(colour), (9, 9, 3))
        assert np.abs(jpeg.decode(jpeg.encode(flat, 100)).astype(int) - flat).max() <= 2
    checks = np.where(np.indices((32, 32)).sum(axis=0)[:, :, None] % 2, 255, 0).astype(np.uint8).repeat(3, axis=2)
    assert np.abs(jpeg.decode(jpeg.encode(checks, 100)).astype(int) - checks).max() <= 3


def test_damaged_files_are_told():
    data = jpeg.encode(picture(40, 40))
    for bad in (b"", b"\xff\xd8\xff", data[:30], data[:-300], data[:200] + data[260:], b"GIF89a", data.replace(b"\xff\xc0", b"\xff\xc2", 1), b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.decode(bad)
    with pytest.raises(ValueError):
        jpeg.header(70_000, 5)
    assert pixels_of(data[:60], 9, 9) is None and pixels_of(b"1234", 9, 9) is None


def tiles_of(pixels, side, overlap=0, how=None):
    """(px, py, tile_w, tile_h, data) of an image cut into tiles, in no order."""
    h, w = pixels.shape[:2]
    out = []
    for y in range(0, h, side):
        for x in range(0, w, side):
            x0, y0 = x - (overlap if x else 0), y - (overlap if y else 0)
            part = pixels[y0 : y + side + overlap, x0 : x + side + overlap]
            out.append((x0, y0, part.shape[1], part.shape[0], how(part) if how else part.tobytes()))
    return out[::-1]


TILES = "image_id long, width int, height int, px int, py int, tile_w int, tile_h int, data binary"


def pasted(strips):
    rows = sorted(strips, key=lambda r: r.strip)
    return np.concatenate([np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in rows])


@pytest.mark.parametrize("strip", [None, 16, 40])
def test_jpeg_tiles_to_a_jpeg_file(spark, tmp_path, strip):
    """Tiles as a server sends them, painted in strips, coded apart, joined in a file that another decoder reads."""
    pixels = picture(150, 210, 5)
    code = lambda p: jpeg.encode(p, 98)
    tiles = [(7, 210, 150, *t) for t in tiles_of(pixels, 64, 1, code)] + [(8, 30, 20, 0, 0, None, None, code(pixels[:20, :30])), (9, 5, 5, 0, 0, 5, 5, b"\xff\xd8\xffbad")]
    rows = with_sizes(spark.createDataFrame(tiles, TILES).withColumn("tile_w", F.when(F.col("image_id") == 7, F.col("tile_w"))))
    strips = mosaic(rows, strip=strip)
    plain = np.zeros((150, 210, 3), np.uint8)
    for x, y, w, h, data in sorted(tiles_of(pixels, 64, 1, code), key=lambda t: (t[1], t[0])):
        plain[y : y + h, x : x + w] = jpeg.decode(data)
    assert (pasted([r for r in strips.collect() if r.image_id == 7]) == plain).all()
    found = {r.path.rsplit("/", 1)[1]: r for r in documents.write_jpegs(strips, f"file://{tmp_path}/out").collect()}
    assert sorted(found) == ["7.jpg", "8.jpg", "9.jpg"] and not list(tmp_path.glob("out/.*"))
    data = (tmp_path / "out/7.jpg").read_bytes()
    assert data == jpeg.encode(plain) and found["7.jpg"].bytes == len(data)
    assert np.abs(java_decoded(spark, data) - jpeg.decode(data)).max() <= 3
    assert (jpeg.decode((tmp_path / "out/9.jpg").read_bytes()) == 0).all()


def test_sizes_of_tiles(spark):
    rows = spark.createDataFrame([(jpeg.encode(picture(9, 13)), 1, 1), (b"abc", 5, 6), (b"\xff\xd8\xff", 7, 8), (None, 2, 3)], "data binary, tile_w int, tile_h int")
    assert [(r.tile_w, r.tile_h) for r in with_sizes(rows).collect()] == [(13, 9), (5, 6), (7, 8), (2, 3)]
    assert [(r.tile_w, r.tile_h) for r in with_sizes(rows.select("data")).collect()] == [(13, 9), (None, None), (None, None), (None, None)]


def plainly_scaled(pixels, width, height):
    """Area means, pixel by pixel."""
    h, w = pixels.shape[:2]
    out = np.zeros((height, width, 3), np.uint8)
    for i in range(height):
        for j in range(width):
            total, weight = np.zeros(3), 0.0
            for y in range(h):
                for x in range(w):
                    part = max(0, min((i + 1) * h / height, y + 1) - max(i * h / height, y)) * max(0, min((j + 1) * w / width, x + 1) - max(j * w / width, x))
                    total, weight = total + part * pixels[y, x], weight + part
            out[i, j] = np.floor(total / weight + 0.5 + 1e-9)
    return out


def test_area_means():
    pixels = picture(9, 7, 6)
    for width, height in ((7, 9), (3, 4), (1, 1), (6, 9), (7, 2)):
        assert (scaled(pixels, width, height) == plainly_scaled(pixels, width, height)).all()
    assert np.allclose(shares(10, 4).sum(axis=1), 1) and np.allclose(shares(10, 4).sum(axis=0), 0.4)
    flat = np.full((50, 31, 3), 201, np.uint8)
    assert (scaled(flat, 13, 17) == 201).all()


@pytest.mark.parametrize("strip", [None, 8, 24])
@pytest.mark.parametrize("area", [1200, 5000, 10**6])
def test_scaled_strips_equal_a_whole_image(spark, strip, area):
    pixels = picture(90, 120, 7)
    tiles = tiles_of(pixels, 32, 1)
    rows = spark.createDataFrame([(1, 120, 90, *t) for t in tiles], TILES)
    ratio = spark.range(1).select(canvas_ratio(F.lit(120), F.lit(90), area).alias("r")).first().r
    canvas = np.zeros((int(90 * ratio), int(120 * ratio), 3), np.uint8)
    for x, y, w, h, data in sorted(tiles, key=lambda t: (t[1], t[0])):
        part = plainly_scaled(np.frombuffer(data, np.uint8).reshape(h, w, 3), int(np.ceil(w * ratio)), int(np.ceil(h * ratio))) if ratio < 1 else np.frombuffer(data, np.uint8).reshape(h, w, 3)
        left, top = int(x * ratio), int(y * ratio)
        part = part[: len(canvas) - top, : canvas.shape[1] - left]
        canvas[top : top + part.shape[0], left : left + part.shape[1]] = part
    got = mosaic(rows, strip=strip, area=area).collect()
    assert (pasted(got) == canvas).all() and (ratio == 1) == (area == 10**6)
    assert scaled_places(rows, area).filter("dx + dw > cw + 2 or dy + dh > ch + 2").count() == 0


def test_no_tiles(spark, tmp_path):
    none = spark.createDataFrame([], TILES)
    assert mosaic(none, area=100).count() == 0 and coded_strips(mosaic(none)).count() == 0
    assert documents.write_jpegs(mosaic(none), f"file://{tmp_path}/none").count() == 0


def test_painting_is_dealt_over_tasks_by_pixels_not_by_bytes(spark):
    """A few kilobytes of one-coloured tiles are gigabytes of pixels; by their size in bytes they made one task, which painted alone."""
    from tessera.operators.mosaic import mosaic

    rows = [(k, 96, 96, 48 * x, 48 * y, 48, 48, bytes([k, x, y])) for k in range(64) for x in range(2) for y in range(2)]
    tiles = spark.createDataFrame(rows, "image_id long, width int, height int, px int, py int, tile_w int, tile_h int, data binary")
    out = mosaic(tiles, digest=True).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in out}) > 4
    for r in out:
        want = np.zeros((96, 96, 3), np.uint8)
        for x in range(2):
            for y in range(2):
                want[48 * y : 48 * y + 48, 48 * x : 48 * x + 48] = (r.image_id, x, y)
        assert r.checksum == hashlib.sha256(want.tobytes()).hexdigest()
