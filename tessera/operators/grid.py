"""Levels, tile grids and places of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import MAX_CANVAS_AREA, find_max_zoom, unset


def arg_max(levels: Column, value, last: bool = False) -> Column:
    """The element with the largest value(element); the first of equals, or the last. In the row, without a shuffle."""
    place = (lambda i: i) if last else (lambda i: -i)
    return F.array_max(F.transform(levels, lambda x, i: F.struct(value(x).alias("v"), place(i).alias("i"), x.alias("x"))))["x"]


def arg_min(levels: Column, value, last: bool = False) -> Column:
    place = (lambda i: -i) if last else (lambda i: i)
    return F.array_min(F.transform(levels, lambda x, i: F.struct(value(x).alias("v"), place(i).alias("i"), x.alias("x"))))["x"]


def on_canvas(levels: Column, area: int = MAX_CANVAS_AREA) -> Column:
    return F.filter(levels, lambda x: x["width"] * x["height"] < area)


def with_defaults(images: DataFrame) -> DataFrame:
    """Fills nbr_tiles_x, nbr_tiles_y, total_tiles, zoom_factor, base_zoom_level, overlap and zoom of descriptors.

    0 counts as missing. Columns that `images` lacks are added.
    """
    col = lambda name, kind: F.col(name) if name in images.columns else F.lit(None).cast(kind)
    size = F.col("tile_size").cast("double")
    nx = unset(col("nbr_tiles_x", "int"), F.ceil(F.col("width") / size)).cast("int")
    ny = unset(col("nbr_tiles_y", "int"), F.ceil(F.col("height") / size)).cast("int")
    factor, base = unset(col("zoom_factor", "double"), 2.0), F.coalesce(col("base_zoom_level", "int"), F.lit(0))
    zoom = unset(col("max_zoom_level", "int"), find_max_zoom(F.col("width"), F.col("height"), size, factor, base)).cast("int")
    return images.withColumns(
        {"nbr_tiles_x": nx, "nbr_tiles_y": ny, "total_tiles": nx.cast("bigint") * ny, "zoom_factor": factor, "base_zoom_level": base, "overlap": F.coalesce(col("overlap", "int"), F.lit(0)), "zoom": zoom}
    )


def plan_tiles(images: DataFrame, bbox: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A row for each tile (x, y) of each image, with tile_index in reading order and its place px, py.

    bbox (x0, y0, x1, y1, ends excluded) clamps the generated ranges, as a filter after the explode would make all tiles
    first. Images without size or tiles give none. Both explodes are pipelined; nothing is shuffled.
    """
    x0, y0, x1, y1 = bbox or (0, 0, None, None)
    images = with_defaults(images)
    ends = [F.least(F.col(n), F.lit(limit)) if limit is not None else F.col(n) for n, limit in (("nbr_tiles_x", x1), ("nbr_tiles_y", y1))]
    some = images.filter((ends[0] > x0) & (ends[1] > y0))
    some = some.withColumn("y", F.explode(F.sequence(F.lit(y0), (ends[1] - 1).cast("int")))).withColumn("x", F.explode(F.sequence(F.lit(x0), (ends[0] - 1).cast("int"))))
    place = lambda k: (F.col(k) * F.col("tile_size") - F.when(F.col(k) > 0, F.col("overlap")).otherwise(0)).cast("int")
    return some.withColumns({"tile_index": F.col("y").cast("bigint") * F.col("nbr_tiles_x") + F.col("x"), "px": place("x"), "py": place("y")})


def canvas_ratio(width: Column, height: Column, area: int = MAX_CANVAS_AREA) -> Column:
    """What an image is scaled by to fit a canvas."""
    return F.least(F.sqrt(F.lit(float(area)) / (width.cast("double") * height)), F.lit(1.0))


def halved_levels(width: Column, height: Column, tile: int = 512) -> Column:
    """array<struct(width, height, level, dx, dy)>, smallest first: halved, rounded up, while twice the larger side exceeds a tile.

    The first is always the image itself. dx and dy are the padding fractions of a square that doubles from one tile.
    """
    half = lambda v, k: F.ceil(v / F.pow(F.lit(2.0), k)).cast("bigint")
    candidates = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda k: (k == 0) | (2 * F.greatest(half(width, k), half(height, k)) > tile))
    kept = F.reverse(candidates)

    def level(k: Column, i: Column) -> Column:
        w, h, size = half(width, k), half(height, k), F.lit(float(tile)) * F.pow(F.lit(2.0), i)
        return F.struct(w.alias("width"), h.alias("height"), k.alias("level"), ((size - w) / (2 * w)).alias("dx"), ((size - h) / (2 * h)).alias("dy"))

    return F.transform(kept, level)


def crops(width: Column, height: Column, x: Column, y: Column, tile: Column | int) -> tuple[Column, Column]:
    """Width and height of a tile that the image's edge may cut."""
    return F.least(F.lit(0) + tile, width - x * tile), F.least(F.lit(0) + tile, height - y * tile)
