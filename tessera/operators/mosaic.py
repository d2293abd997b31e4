"""Tiles painted on one raster for each image, in reading order, scaled to fit a canvas, and how far a run has come."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.grid import canvas_ratio

#: Pixels of a strip that a task paints at once.
PIXELS = 1 << 24

#: Tiles of one colour that a strip keeps before it is painted, and bytes of equal rows that are hashed at once, in a core's cache.
KEPT, HASHED = 1 << 14, 1 << 17


@functools.lru_cache(64)
def _decoded(data: bytes) -> np.ndarray:
    """A small tile's pixels; blank tiles come again and again."""
    from tessera.sources import jpeg

    out = jpeg.decode(data)
    out.flags.writeable = False
    return out


def pixels_of(data: bytes, width: int, height: int) -> np.ndarray | None:
    """The 8-bit RGB pixels of a tile: JPEG, raw rows, or one pixel for all; None for what can't be read."""
    from tessera.sources import jpeg

    pixels = np.frombuffer(data, np.uint8)
    if len(pixels) == 3:  # no JPEG is as short, though this colour may begin like one
        return np.broadcast_to(pixels, (height, width, 3))
    if jpeg.is_jpeg(data):
        try:
            return _decoded(data) if len(data) < 8192 else jpeg.decode(data)
        except ValueError:
            return None
    return pixels.reshape(height, width, 3) if len(pixels) == 3 * width * height else None


@functools.lru_cache(256)
def shares(size: int, to: int) -> np.ndarray:
    """(to, size): how much of each of `size` samples is in each of `to` as long as all of them; rows sum up to 1."""
    edges = np.arange(to + 1) * size / to
    low, high = edges[:-1, None], edges[1:, None]
    cell = np.arange(size)[None, :]
    return np.clip(np.minimum(high, cell + 1) - np.maximum(low, cell), 0, None) * to / size


def scaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels drawn in another size: each is the mean, by area, of what it covers."""
    h, w = pixels.shape[:2]
    if (h, w) == (height, width):
        return pixels
    if pixels.strides[:2] == (0, 0):  # one pixel for all
        return np.broadcast_to(pixels[0, 0], (height, width, 3))
    down = (shares(h, height) @ pixels.reshape(h, w * 3).astype(np.float64)).reshape(height, w, 3)
    return np.floor(shares(w, width) @ down + 0.5 + 1e-9).astype(np.uint8)


def runs(width: int, height: int, tiles: list[tuple]) -> Iterator[tuple[bytes, int]]:
    """(row, count): runs of equal rows, from the top, under tiles of one colour (x0, x1, y0, y1, colour), black elsewhere.

    Later tiles cover earlier ones; y0 never falls from tile to tile. Only one row of a run is painted.
    """
    above, at = [], 0
    for low, high in itertools.pairwise(sorted({0, height, *(t[2] for t in tiles), *(t[3] for t in tiles)})):
        above = [t for t in above if t[3] > low]
        while at < len(tiles) and tiles[at][2] <= low:
            above.append(tiles[at])
            at += 1
        row = bytearray(3 * width)
        for x0, x1, _, _, colour in above:
            row[3 * x0 : 3 * x1] = colour * (x1 - x0)
        yield bytes(row), high - low


def hashed(rows: Iterator[tuple[bytes, int]]) -> str:
    """SHA-256 in hex of runs of equal rows, which are laid out a few at a time."""
    out = hashlib.sha256()
    for row, count in rows:
        size = len(row) * count
        some = memoryview(row * min(count, max(1, HASHED // max(len(row), 1))))
        for at in range(0, size, len(some) or 1):
            out.update(some[: size - at])
    return out.hexdigest()


def with_sizes(tiles: DataFrame) -> DataFrame:
    """Fills tile_w and tile_h of JPEG tiles (data) from their own headers, as servers cut tiles as they like.

    Other tiles, and those whose header can't be read, keep what they have, if there are such columns.
    """

    def sizes(data: pd.Series) -> pd.DataFrame:
        from tessera.sources import jpeg

        out = []
        for x in data:
            try:
                out.append(jpeg.size_of(x) if x is not None and jpeg.is_jpeg(x) else (None, None))
            except ValueError:
                out.append((None, None))
        return pd.DataFrame(out, columns=["w", "h"], dtype="Int32")

    known = lambda name: F.col(name) if name in tiles.columns else F.lit(None).cast("int")
    found = tiles.withColumn("__size", F.pandas_udf(sizes, "w int, h int")("data"))
    return found.withColumns({"tile_w": F.coalesce("__size.w", known("tile_w")), "tile_h": F.coalesce("__size.h", known("tile_h"))}).drop("__size")


def tasks_of(spark: SparkSession) -> int:
    """How many tasks paint: few bytes of tiles are many pixels, so it isn't left to the size of the rows. No core waits for a last few."""
    cores = spark.sparkContext.defaultParallelism
    return cores * max(2, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / cores))


def mosaic(tiles: DataFrame, strip: int | None = None, digest: bool = False, area: int | None = None) -> DataFrame:
    """(image_id, strip, width, height, top, full_height, data) from tiles (image_id, width, height, px, py, tile_w, tile_h, data).

    top is a strip's first row, full_height that of the image. data are 8-bit RGB rows, of tiles and of the result; a tile may be a JPEG too, with its size from with_sizes(), and a
    tile of one colour its one pixel. What can't be read is left out, and places that no tile covers are black. With `digest`
    there is checksum, the SHA-256 of the result's data in hex, instead of data. Later tiles, by (py, px), cover earlier
    ones. An image is cut into strips of `strip` rows, or of PIXELS pixels at most; a task paints one at a time, so no image
    has to fit a task whole, and tiles pass by one after the other. Tiles over a cut go to both. A strip under tiles of one
    colour alone is kept as runs of equal rows, and hashed or laid out row by row without a canvas.

    With `area`, images of more pixels are painted smaller, on a canvas of that area at most: a tile is drawn where
    scaled_places() has it, each pixel the mean of what it covers. A tile is scaled as a whole, so that strips fit together.
    """
    if area is not None:
        tiles = scaled_places(tiles, area)
    else:
        tiles = tiles.withColumns({"ratio": F.lit(1.0), "cw": F.col("width"), "ch": F.col("height"), "dx": F.col("px"), "dy": F.col("py"), "dw": F.col("tile_w"), "dh": F.col("tile_h")})
    # A strip has whole rows of 8 pixels, which images are coded in.
    rows = F.lit(strip) if strip else F.greatest(F.lit(8), F.floor(F.lit(PIXELS) / F.greatest(F.col("cw"), F.lit(1)).cast("double") / 8) * 8)
    tiles = tiles.withColumn("rows", rows.cast("int"))
    ends = F.floor((F.col("dy") + F.greatest(F.col("dh"), F.lit(1)) - 1) / F.col("rows").cast("double")).cast("int")
    most = F.floor((F.greatest(F.col("ch"), F.lit(1)) - 1) / F.col("rows").cast("double")).cast("int")
    cut = tiles.withColumn("strip", F.explode(F.sequence(F.floor(F.col("dy") / F.col("rows").cast("double")).cast("int"), ends))).filter(F.col("strip") <= F.greatest(most, F.floor(F.col("dy") / F.col("rows").cast("double")).cast("int")))
    cut = cut.select("image_id", "strip", "rows", "cw", "ch", "ratio", "px", "py", "dx", "dy", "tile_w", "tile_h", "data")

    drawn = lambda side, ratio: side if area is None else math.ceil(side * ratio)

    def draw(canvas: np.ndarray, top: int, x: int, y: int, width: int, height: int, ratio: float, data: bytes) -> None:
        pixels = pixels_of(data, width, height)
        if pixels is None:
            return
        if area is not None:
            pixels = scaled(pixels, *(drawn(side, ratio) for side in pixels.shape[1::-1]))
        h, w = pixels.shape[:2]
        y0, y1, x1 = max(y, top), min(y + h, top + len(canvas)), min(x + w, canvas.shape[1])
        if y1 > y0 and x1 > x and pixels.strides[:2] == (0, 0):  # one pixel for all: a row of it, copied as whole rows
            canvas.reshape(len(canvas), -1)[y0 - top : y1 - top, 3 * x : 3 * x1] = np.tile(pixels[0, 0], x1 - x)
        elif y1 > y0 and x1 > x:
            canvas[y0 - top : y1 - top, x:x1] = pixels[y0 - y : y1 - y, : x1 - x]

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, canvas, top, full, room = None, None, 0, 0, np.empty(0, np.uint8)
        wide, high, flat = 0, 0, []  # tiles of one colour, as long as a strip has no others

        def painted() -> np.ndarray:
            nonlocal room  # a task's strips share their memory, which would be mapped anew for each
            size = 3 * high * wide
            if len(room) < size:
                room = np.empty(size, np.uint8)
            room[:size] = 0
            for x0, x1, y0, y1, colour in flat:
                room[:size].reshape(high, -1)[y0:y1, 3 * x0 : 3 * x1] = np.frombuffer(colour * (x1 - x0), np.uint8)
            return room[:size].reshape(high, wide, 3)

        def done() -> tuple:
            if canvas is None:
                rows = runs(wide, high, flat)
                result = hashed(rows) if digest else b"".join(row * count for row, count in rows)
            else:
                result = hashlib.sha256(canvas).hexdigest() if digest else canvas.tobytes()
            return (*key, wide, high, top, full, result)

        def batch_of(strips: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), *[pa.int32()] * 5, pa.string() if digest else pa.binary())
            columns = [pa.array(v, k) for v, k in zip(zip(*strips, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["image_id", "strip", "width", "height", "top", "full_height", last])

        made = []  # one strip of data, or several checksums
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                # Lists by way of numpy: fifteen times as fast as Arrow's own.
                for image, strip_, rows_, cw, ch, ratio, x, y, w, h, data in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.slice(at, 256).columns), strict=True):
                    if key != (image, strip_):
                        if key is not None:
                            made.append(done())
                        if len(made) >= (256 if digest else 1):
                            yield batch_of(made)
                            made = []
                        key, top, full, canvas, flat = (image, strip_), strip_ * rows_, ch, None, []
                        wide, high = cw, max(min(rows_, full - top), 0)
                    if data is None:
                        continue
                    if canvas is None and len(data) == 3 and x >= 0 and len(flat) < KEPT:
                        x1, y0, y1 = min(x + drawn(w, ratio), wide), max(y - top, 0), min(y - top + drawn(h, ratio), high)
                        if x1 > x and y1 > y0:
                            flat.append((x, x1, y0, y1, data))
                        continue
                    if canvas is None:
                        canvas, flat = painted(), []
                    draw(canvas, top, x, y, w, h, ratio, data)
        if key is not None:
            yield batch_of([*made, done()])

    last, kind = ("checksum", "string") if digest else ("data", "binary")
    cut = cut.withColumns({c: F.col(c).cast("int") for c in ("cw", "ch", "dx", "dy")} | {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("tile_w", "tile_h")}).withColumn("image_id", F.col("image_id").cast("long"))
    dealt = cut.repartition(tasks_of(tiles.sparkSession), "image_id", "strip").sortWithinPartitions("image_id", "strip", "py", "px").drop("px", "py")
    return dealt.mapInArrow(paint, f"image_id long, strip int, width int, height int, top int, full_height int, {last} {kind}")


def scaled_places(tiles: DataFrame, area: int | None = None) -> DataFrame:
    """Adds ratio, the canvas cw x ch, and dx, dy, dw and dh: where a tile of tile_w x tile_h pixels is drawn on it."""
    r = F.col("ratio")
    out = tiles.withColumn("ratio", canvas_ratio(F.col("width"), F.col("height"), *([] if area is None else [area])))
    out = out.withColumns({c: F.greatest(F.lit(1), F.floor(F.col(s) * r)).cast("int") for c, s in (("cw", "width"), ("ch", "height"))})
    return out.withColumns({"dx": F.floor(F.col("px") * r).cast("int"), "dy": F.floor(F.col("py") * r).cast("int"), "dw": F.ceil(F.col("tile_w") * r).cast("int"), "dh": F.ceil(F.col("tile_h") * r).cast("int")})


def coded_strips(strips: DataFrame, quality: int = 95) -> DataFrame:
    """(image_id, strip, data) from mosaic()'s strips: the rows of blocks of a JPEG, each strip coded apart.

    The first strip of an image brings the file's beginning and the last one its end; all but the last have whole rows of
    8 pixels. An image needs a tile in each strip to be whole. Strips are coded as they are painted, in the same task.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.sources import jpeg

        for batch in batches:
            out = []
            for width, height, top, full, data in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), batch.column(6), strict=True):
                pixels = np.frombuffer(data.as_buffer(), np.uint8).reshape(height, width, 3)
                ends = top + height == full
                out.append((b"" if top else jpeg.header(width, full, quality)) + jpeg.encode_rows(pixels, top // 8, ends, quality) + (jpeg.END if ends else b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["image_id", "strip", "data"])

    return strips.select("image_id", "strip", "width", "height", "top", "full_height", "data").mapInArrow(code, "image_id long, strip int, data binary")


def progress(images: DataFrame, results: DataFrame) -> DataFrame:
    """(image_id, total_tiles, loaded, failed, done, first_error) from planned images and tile results (image_id, seq, status, error)."""
    counts = results.groupBy("image_id").agg(
        F.count_if(F.col("status") == "ok").alias("loaded"), F.count_if(F.col("status") != "ok").alias("failed"), F.min(F.when(F.col("error").isNotNull(), F.struct("seq", "error"))).alias("first")
    )
    out = images.select("image_id", "total_tiles").join(counts, "image_id", "left")
    loaded, failed = F.coalesce("loaded", F.lit(0)), F.coalesce("failed", F.lit(0))
    return out.select("image_id", "total_tiles", loaded.alias("loaded"), failed.alias("failed"), (loaded >= F.col("total_tiles")).alias("done"), F.col("first.error").alias("first_error"))
