"""Which of many boxes lie on which of many images, and which tiles those need: a spatial join on cells of a quadtree.

A rectangle has the level whose cells are at least as large as itself, so it touches four at most there, and no more on any
coarser level. Two rectangles meet on the coarser of their two levels, as rows with equal cells; the exact test comes after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The finest level; salts of a cell.
FINEST, SALTS = 24, 8


def _sane(rows: DataFrame) -> DataFrame:
    """Rectangles with an inside; bounds that are null or not finite have none."""
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in ("x0", "y0", "x1", "y1")]
    good = finite[0]
    for c in finite[1:]:
        good &= c
    return rows.filter(good & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))


def _level(span: float) -> Column:
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double")
    return F.least(F.lit(FINEST), F.greatest(F.lit(0), F.floor(F.log2(F.lit(span) / side)))).cast("int")


def _cells(rows: DataFrame, levels: list[int], low: tuple[float, float], span: float) -> DataFrame:
    """A row for each cell that a rectangle touches on those of the levels that are not finer than its own."""
    at = rows.withColumn("m", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda m: m <= F.col("level"))))
    size = F.lit(span) / F.pow(F.lit(2.0), "m")
    place = lambda c, base: F.floor((F.col(c).cast("double") - base) / size).cast("long")
    end = lambda c, base: F.ceil((F.col(c).cast("double") - base) / size).cast("long") - 1
    # Rounding may put an end before its beginning; it is in the beginning's cell then.
    at = at.withColumn("cx", F.explode(F.sequence(place("x0", low[0]), F.greatest(place("x0", low[0]), end("x1", low[0])))))
    return at.withColumn("cy", F.explode(F.sequence(place("y0", low[1]), F.greatest(place("y0", low[1]), end("y1", low[1])))))


def overlaps(boxes: DataFrame, images: DataFrame, salts: int = SALTS) -> DataFrame:
    """(box_id, image_id, x0, y0, x1, y1): the common part of each box and image that have one, once for each pair.

    boxes (box_id, x0, y0, x1, y1) and images (image_id, x0, y0, x1, y1) are rectangles of numbers without their right and
    lower edges, so that neighbours don't overlap. Rectangles that are empty, turned round or not finite overlap nothing;
    rows that repeat an id are rectangles each, told apart by their bounds (equal rows count once). No rows give no rows.

    Both sides are dealt by cells, never all against all. A cell that many rectangles share is dealt over `salts` parts,
    to which the rows on their own level, whose cell it is, are copied. The driver gets the bounds of all and the levels
    that there are, 25 at most.
    """
    sides = []
    for rows, name in ((boxes, "box_id"), (images, "image_id")):
        sides.append(_sane(rows.select(F.col(name).alias("id"), "x0", "y0", "x1", "y1")).distinct())
    both = sides[0].drop("id").unionByName(sides[1].drop("id")).agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if both[0] is None:
        both = (0, 0, 1, 1)
    low = (float(both[0]), float(both[1]))
    span = max(float(both[2]) - low[0], float(both[3]) - low[1])
    sides = [s.withColumn("level", _level(span)) for s in sides]
    levels = [sorted(r.level for r in s.select("level").distinct().collect()) for s in sides]
    salt = F.pmod(F.xxhash64("id", "x0", "y0"), F.lit(salts)).cast("int")
    found = None
    # Pairs whose coarser level is the first side's, and pairs where it is the second's alone.
    for own, other in ((0, 1), (1, 0)):
        if not levels[own] or not levels[other]:
            continue
        at_home = _cells(sides[own], levels[own], low, span).filter(F.col("m") == F.col("level")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        above = _cells(sides[other], levels[own], low, span).withColumn("salt", salt)
        if own:
            above = above.filter("m < level")
        names = ["id", "x0", "y0", "x1", "y1"]
        left = at_home.select("m", "cx", "cy", "salt", *(F.col(c).alias(f"{c}_{own}") for c in names))
        right = above.select("m", "cx", "cy", "salt", *(F.col(c).alias(f"{c}_{other}") for c in names))
        pairs = left.join(right, ["m", "cx", "cy", "salt"])
        common = {"x0": F.greatest("x0_0", "x0_1"), "y0": F.greatest("y0_0", "y0_1"), "x1": F.least("x1_0", "x1_1"), "y1": F.least("y1_0", "y1_1")}
        pairs = pairs.withColumns(common).filter("x0 < x1 and y0 < y1")
        # A pair may meet in four cells; the one that holds the common part's corner tells of it.
        size = F.lit(span) / F.pow(F.lit(2.0), "m")
        home = (F.floor((F.col("x0").cast("double") - low[0]) / size) == F.col("cx")) & (F.floor((F.col("y0").cast("double") - low[1]) / size) == F.col("cy"))
        out = pairs.filter(home).select(F.col("id_0").alias("box_id"), F.col("id_1").alias("image_id"), "x0", "y0", "x1", "y1")
        found = out if found is None else found.unionByName(out)
    if found is None:
        return boxes.select("box_id").limit(0).join(images.select("image_id", "x0", "y0", "x1", "y1").limit(0), F.lit(True))
    return found


def tiles_in_boxes(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """(box_id, image_id, x, y): the tiles of each image that a box needs.

    images (image_id, x0, y0, x1, y1, width, height, tile_size) are placed by their bounds, with y downwards; width and
    height are their pixels. A tile is needed if the box covers some of it. Image ids are those of one row each.
    """
    common = overlaps(boxes, images).select("box_id", "image_id", *(F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")))
    met = common.join(images.select("image_id", "x0", "y0", "x1", "y1", "width", "height", "tile_size"), "image_id")
    ranges = {}
    for a, b, side, k in (("x0", "x1", "width", "x"), ("y0", "y1", "height", "y")):
        scale = F.col(side) / (F.col(b) - F.col(a)).cast("double") / F.col("tile_size")
        last = F.ceil(F.col(side) / F.col("tile_size").cast("double")) - 1
        ranges[k] = F.sequence(F.floor((F.col(f"o{a}") - F.col(a)) * scale).cast("int"), F.greatest(F.floor((F.col(f"o{a}") - F.col(a)) * scale), F.least(last, F.ceil((F.col(f"o{b}") - F.col(a)) * scale) - 1)).cast("int"))
    return met.select("box_id", "image_id", F.explode(ranges["x"]).alias("x"), "y0", "y1", "oy0", "oy1", "height", "tile_size").withColumn("y", F.explode(ranges["y"])).select("box_id", "image_id", "x", "y")
