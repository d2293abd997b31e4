"""Queries over the test tables, with DuckDB SQL. The tables hold no tile metadata, so sizes are made from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as t
from tessera.operators import detect, grid, tileurl

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A descriptor for each part: width, height and a tile size of 256."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("image_id"), (64 + (k * 7919) % 4000).alias("width"), (64 + (k * 104729) % 3000).alias("height"), F.lit(256).alias("tile_size"))


def described(spark: SparkSession, sf_dir: str, name: str, origin: str | None, **more) -> DataFrame:
    place = F.lit(None).cast("string") if origin is None else F.concat(F.lit(origin), F.col("image_id").cast("string"))
    return images(spark, sf_dir).withColumns({"format": F.lit(name), "origin": place} | more)


IMG = "img AS (SELECT p_partkey AS image_id, 64 + (p_partkey * 7919) % 4000 AS width, 64 + (p_partkey * 104729) % 3000 AS height FROM part)"
GRID = IMG + """, g AS (SELECT *, CAST(ceil(width / 256.0) AS INTEGER) AS nx, CAST(ceil(height / 256.0) AS INTEGER) AS ny,
    CAST(ceil(ln(greatest(width, height) / CAST(256 AS DOUBLE)) / ln(CAST(2 AS DOUBLE))) AS INTEGER) AS zoom FROM img),
  gy AS (SELECT *, CAST(unnest(range(0, ny)) AS INTEGER) AS y FROM g), tiles AS (SELECT *, CAST(unnest(range(0, nx)) AS INTEGER) AS x FROM gy)"""


def urls(spark: SparkSession, sf_dir: str, name: str, origin: str | None, resolve: bool = False, **more) -> DataFrame:
    img = described(spark, sf_dir, name, origin, **more)
    tiles = grid.plan_tiles(tileurl.with_origin_parts(img) if resolve else img)
    return tileurl.with_tile_urls(tiles, [name], resolve).select("image_id", "x", "y", "url")


@query(f"WITH {GRID} SELECT image_id, zoom, x, y, x * 256 AS px, y * 256 AS py, CAST(y * nx + x AS BIGINT) AS tile_index, 'http://img.example.org/' || image_id || '_files/' || zoom || '/' || x || '_' || y || '.jpg' AS url FROM tiles")
def tile_plan(spark, sf_dir):
    """Descriptors to tiles with places and Deep Zoom URLs."""
    img = described(spark, sf_dir, "Seadragon", "http://img.example.org/", image_format=F.lit("jpg")).withColumn("origin", F.concat("origin", F.lit("_files/")))
    return tileurl.with_tile_urls(grid.plan_tiles(img), ["Seadragon"]).select("image_id", "zoom", "x", "y", "px", "py", "tile_index", "url")


@query(f"WITH {GRID} SELECT image_id, x, y, CAST(y * nx + x AS BIGINT) AS tile_index FROM tiles")
def tile_grid(spark, sf_dir):
    return grid.plan_tiles(images(spark, sf_dir)).select("image_id", "x", "y", "tile_index")


@query(f"WITH {GRID} SELECT image_id, x, y, x * 256 - CASE WHEN x > 0 THEN 1 ELSE 0 END AS px, y * 256 - CASE WHEN y > 0 THEN 1 ELSE 0 END AS py FROM tiles")
def tile_overlap_position(spark, sf_dir):
    return grid.plan_tiles(images(spark, sf_dir).withColumn("overlap", F.lit(1))).select("image_id", "x", "y", "px", "py")


@query(f"WITH {GRID} SELECT image_id, x, y FROM tiles WHERE x >= 1 AND x < 3 AND y >= 2 AND y < 5")
def tile_grid_bbox(spark, sf_dir):
    return grid.plan_tiles(images(spark, sf_dir), (1, 2, 3, 5)).select("image_id", "x", "y")


@query(f"WITH {GRID} SELECT image_id, zoom FROM g")
def find_max_zoom(spark, sf_dir):
    return grid.with_defaults(images(spark, sf_dir)).select("image_id", "zoom")


@query("SELECT o_orderkey AS image_id, CAST(ceil(log2(greatest(1 + o_orderkey % 9000, 1 + (o_orderkey * 31) % 7000))) AS INTEGER) AS zoom FROM orders")
def dzi_max_zoom(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("image_id"), F.ceil(F.log2(F.greatest(1 + k % 9000, 1 + (k * 31) % 7000).cast("double"))).cast("int").alias("zoom"))


ZOOMIFY = GRID + """, lv AS (SELECT image_id, unnest(range(0, greatest(zoom, -1) + 1)) AS z, width, height FROM g),
  n AS (SELECT image_id, CAST(sum(ceil(width / pow(2.0, z) / 256.0) * ceil(height / pow(2.0, z) / 256.0)) AS BIGINT) AS total FROM lv GROUP BY image_id),
  c AS (SELECT g.*, coalesce(total, 0) AS total, CASE WHEN image_id % 3 = 0 THEN nx * ny WHEN image_id % 3 = 1 THEN coalesce(total, 0) ELSE coalesce(total, 0) + 7 END AS num_tiles FROM g LEFT JOIN n USING (image_id)),
  m AS (SELECT *, CASE WHEN total <> num_tiles THEN CAST(ceil(ln(greatest(width, height) / CAST(257 AS DOUBLE)) / ln(CAST(2 AS DOUBLE))) AS INTEGER) END AS mz FROM c)"""


def _zoomify_images(spark, sf_dir):
    from tessera.operators.parse import zoomify_zoom

    img = grid.with_defaults(images(spark, sf_dir)).drop("overlap", "zoom_factor", "base_zoom_level")
    total = F.aggregate(F.when(F.col("zoom") >= 0, F.sequence(F.lit(0), F.greatest("zoom", F.lit(0)))).otherwise(F.array().cast("array<int>")), F.lit(0).cast("bigint"), lambda acc, z: acc + F.ceil(F.col("width") / F.pow(F.lit(2.0), z) / 256.0) * F.ceil(F.col("height") / F.pow(F.lit(2.0), z) / 256.0))
    n = F.when(F.col("image_id") % 3 == 0, F.col("total_tiles")).when(F.col("image_id") % 3 == 1, total).otherwise(total + 7)
    return img.withColumn("num_tiles", n).withColumn("max_zoom_level", zoomify_zoom()).withColumns({"format": F.lit("Zoomify"), "origin": F.lit(None).cast("string")})


@query(f"WITH {ZOOMIFY} SELECT image_id, CAST(num_tiles AS BIGINT) AS num_tiles, num_tiles = nx * ny AS full_resolution_only, mz AS max_zoom_level FROM m")
def zoomify_numtiles(spark, sf_dir):
    return _zoomify_images(spark, sf_dir).select("image_id", "num_tiles", (F.col("num_tiles") == F.col("total_tiles")).alias("full_resolution_only"), "max_zoom_level")


@query(f"WITH {ZOOMIFY}, ty AS (SELECT *, CAST(unnest(range(0, ny)) AS INTEGER) AS y FROM m), tx AS (SELECT *, CAST(unnest(range(0, nx)) AS INTEGER) AS x FROM ty) SELECT image_id, x, y, 'TileGroup' || CASE WHEN num_tiles = nx * ny THEN 0 ELSE CAST(floor((num_tiles - nx * ny + x + y * nx) / 256.0) AS BIGINT) END || '/' || coalesce(nullif(mz, 0), zoom) || '-' || x || '-' || y || '.jpg' AS url FROM tx")
def zoomify_tilegroup_url(spark, sf_dir):
    return tileurl.with_tile_urls(grid.plan_tiles(_zoomify_images(spark, sf_dir)), ["Zoomify"]).select("image_id", "x", "y", "url")


@query(f"WITH {GRID} SELECT image_id, x, y, 'http://h/' || image_id || zoom || '/' || x || '_' || y || '.png' AS url FROM tiles")
def dzi_url(spark, sf_dir):
    return urls(spark, sf_dir, "Seadragon", "http://h/", image_format=F.lit("png"))


@query(f"WITH {GRID}, s AS (SELECT *, least(256, width - x * 256) AS sx, least(256, height - y * 256) AS sy FROM tiles) SELECT image_id, x, y, 'http://h/' || image_id || '/' || x * 256 || ',' || y * 256 || ',' || sx || ',' || sy || '/' || sx || ',' || sy || '/0/default.jpg' AS url FROM s")
def iiif_url(spark, sf_dir):
    return urls(spark, sf_dir, "IIIF", "http://h/", quality=F.lit("default"), image_format=F.lit("jpg"))


@query(f"WITH {GRID} SELECT image_id, x, y, 'http://h/?FIF=' || image_id || '&JTL=' || zoom || ',' || (x + y * nx) AS url FROM tiles")
def iip_url(spark, sf_dir):
    return urls(spark, sf_dir, "IIPImage", "http://h/?FIF=")


@query(f"WITH {GRID} SELECT image_id, x, y, 'http://h/' || image_id || '?cmd=tile&x=' || x || '&y=' || y || '&z=1' AS url FROM tiles")
def xlimage_url(spark, sf_dir):
    return urls(spark, sf_dir, "XLimage", "http://h/", max_zoom_level=F.lit(1))


@query(f"WITH {GRID} SELECT image_id, x, y, 'http://h/m/' || zoom || '_' || (x + y * nx) || '.jpg' AS url FROM tiles")
def mnesys_url(spark, sf_dir):
    return urls(spark, sf_dir, "Mnesys", "http://h/m/", True)


@query(f"WITH {GRID} SELECT image_id, x, y, 'http://h/image/tiler/square/' || image_id || '/0/' || x || '/' || y AS url FROM tiles")
def vls_url(spark, sf_dir):
    return urls(spark, sf_dir, "VLS", "http://h/zoom/", True, path=F.concat(F.lit("/image/tiler/square/"), F.col("image_id").cast("string"), F.lit("/0")))


@query(f"WITH {GRID} SELECT image_id, x, y, 'http://h/' || (image_id * 10 + x + y * (nx + 1)) || '.jpg' AS url FROM tiles")
def topviewer_url(spark, sf_dir):
    return urls(spark, sf_dir, "TopViewer", None, url_template=F.lit("http://h/{tile}.jpg"), first_tile=F.col("image_id") * 10, cols=F.ceil(F.col("width") / 256.0) + 1)


@query(f"WITH {GRID} SELECT image_id, x, y, x * 256 / CAST(width AS DOUBLE) AS l, y * 256 / CAST(height AS DOUBLE) AS t, least(256, width - x * 256) / CAST(width AS DOUBLE) AS w, least(256, height - y * 256) / CAST(height AS DOUBLE) AS h FROM tiles")
def fsi_rect(spark, sf_dir):
    tiles = grid.plan_tiles(images(spark, sf_dir))
    return tiles.select("image_id", "x", "y", *(c.alias(n) for n, c in zip("ltwh", tileurl.fsi_rect(), strict=True)))


LEVELS = IMG + """, k AS (SELECT *, unnest(range(0, 12)) AS k FROM img),
  l AS (SELECT image_id, k AS level, CAST(ceil(width / pow(2.0, k)) AS BIGINT) AS w, CAST(ceil(height / pow(2.0, k)) AS BIGINT) AS h FROM k WHERE k = 0 OR 2 * greatest(ceil(width / pow(2.0, k)), ceil(height / pow(2.0, k))) > 512),
  r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY level DESC) - 1 AS i FROM l)"""


@query(f"WITH {LEVELS} SELECT image_id, CAST(i AS INTEGER) AS i, CAST(level AS INTEGER) AS level, w AS width, h AS height, (512 * pow(2.0, i) - w) / (2 * w) AS dx, (512 * pow(2.0, i) - h) / (2 * h) AS dy FROM r")
def lizardtech_levels(spark, sf_dir):
    levels = images(spark, sf_dir).select("image_id", F.posexplode(grid.halved_levels(F.col("width"), F.col("height"))).alias("i", "l"))
    return levels.select("image_id", "i", "l.level", "l.width", "l.height", "l.dx", "l.dy")


@query(f"WITH {LEVELS} SELECT image_id, CAST(i AS INTEGER) AS zoom, ((0 + 0.5) * 512) / w - (512 * pow(2.0, i) - w) / (2 * w) AS cx, ((0 + 0.5) * 512) / h - (512 * pow(2.0, i) - h) / (2 * h) AS cy FROM r WHERE level = 0")
def lizardtech_center(spark, sf_dir):
    """Of the first tile at full size."""
    img = images(spark, sf_dir).withColumn("tile_size", F.lit(512)).withColumn("levels", grid.halved_levels(F.col("width"), F.col("height"))).withColumns({"zoom": F.size("levels") - 1, "x": F.lit(0), "y": F.lit(0)})
    return img.select("image_id", "zoom", *(c.alias(n) for n, c in zip(("cx", "cy"), tileurl.lizardtech_centre(), strict=True)))


def _line_levels(spark, sf_dir):
    """The lines of an order as levels: quantity as width, part of the key as height."""
    line = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("width"), (1 + F.col("l_partkey") % 20).cast("int").alias("height"))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("levels"))


def _top_level(order: str, where: str = "") -> str:
    lines = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS width, CAST(1 + l_partkey % 20 AS INTEGER) AS height FROM lineitem"
    return f"WITH l AS ({lines}), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS k FROM l {where}) SELECT l_orderkey, l_linenumber, width FROM r WHERE k = 1"


@query(_top_level("width DESC, l_linenumber, height"))
def level_argmax_first(spark, sf_dir):
    best = grid.arg_max(F.col("levels"), lambda v: v["width"])
    return _line_levels(spark, sf_dir).select("l_orderkey", best.alias("b")).select("l_orderkey", "b.l_linenumber", "b.width")


@query(_top_level("width DESC, l_linenumber DESC, height DESC"))
def level_argmax_last(spark, sf_dir):
    best = grid.arg_max(F.col("levels"), lambda v: v["width"], last=True)
    return _line_levels(spark, sf_dir).select("l_orderkey", best.alias("b")).select("l_orderkey", "b.l_linenumber", "b.width")


@query(_top_level("width DESC, l_linenumber, height", "WHERE width * height < 400"))
def level_area_filter(spark, sf_dir):
    best = grid.arg_max(grid.on_canvas(F.col("levels"), 400), lambda v: v["width"])
    return _line_levels(spark, sf_dir).select("l_orderkey", best.alias("b")).filter("b is not null").select("l_orderkey", "b.l_linenumber", "b.width")


@query("WITH o AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM lineitem) SELECT l_orderkey, CAST(k - 1 AS INTEGER) AS tile, coalesce(lag(e) OVER (PARTITION BY l_orderkey ORDER BY k), 1000) AS range_begin, e AS range_end FROM o")
def pff_byte_ranges(spark, sf_dir):
    """Running sums of an order's quantities as ends of tiles in a file."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    ends = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).alias("tile"), F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("range_end"))
    before = F.lag("range_end").over(Window.partitionBy("l_orderkey").orderBy("tile"))
    return ends.select("l_orderkey", "tile", F.coalesce(before, F.lit(1000)).alias("range_begin"), "range_end")


LONLAT = "c AS (SELECT c_custkey, -170 + (c_custkey * 37) % 340 + 0.25 AS lon, -80 + (c_custkey * 53) % 160 + 0.25 AS lat FROM customer), m AS (SELECT c_custkey, pi() * 6378137.0 * CAST(lon AS DOUBLE) / 180.0 AS mx, 6378137.0 * ln(tan(pi() * (CAST(lat AS DOUBLE) + 90.0) / 360.0)) AS my FROM c)"


def _places(spark, sf_dir):
    k = F.col("c_custkey")
    at = t.mercator((-170 + (k * 37) % 340).cast("double") + 0.25, (-80 + (k * 53) % 160).cast("double") + 0.25)
    return read(spark, sf_dir, "customer").select("c_custkey", at[0].alias("mx"), at[1].alias("my"))


@query(f"WITH {LONLAT} SELECT c_custkey, CAST(floor(mx) AS BIGINT) AS mx, CAST(floor(my) AS BIGINT) AS my FROM m")
def mercator(spark, sf_dir):
    return _places(spark, sf_dir).select("c_custkey", F.floor("mx").alias("mx"), F.floor("my").alias("my"))


@query(f"WITH {LONLAT} SELECT c_custkey, CAST(floor((mx + 20037508.342789244) / (256 * 0.28e-3 * 1000000)) AS BIGINT) AS tile_col, CAST(floor((20037508.342789244 - my) / (256 * 0.28e-3 * 1000000)) AS BIGINT) AS tile_row FROM m")
def wmts_tile_range(spark, sf_dir):
    span, half = F.lit(256 * 0.28e-3 * 1000000), F.lit(20037508.342789244)
    return _places(spark, sf_dir).select("c_custkey", F.floor((F.col("mx") + half) / span).alias("tile_col"), F.floor((half - F.col("my")) / span).alias("tile_row"))


@query(f"""WITH {IMG}, g AS (SELECT *, CAST(floor(width / 512.0) AS INTEGER) AS nx, CAST(floor(height / 512.0) AS INTEGER) AS ny, width % 512 AS wm, height % 512 AS hm FROM img),
  ty AS (SELECT *, CAST(unnest(range(0, ny + 1)) AS INTEGER) AS y FROM g), tx AS (SELECT *, CAST(unnest(range(0, nx + 1)) AS INTEGER) AS x FROM ty),
  c AS (SELECT *, CASE WHEN x = nx THEN wm ELSE 512 END AS cw, CASE WHEN y = ny THEN hm ELSE 512 END AS ch FROM tx)
  SELECT image_id, x, y, 'http://h/' || image_id || '.jpg?w=' || CASE WHEN x = nx AND y = ny THEN CAST(ceil(wm * 1.5) AS BIGINT) ELSE 2000 END || '&h=' || CASE WHEN x = nx AND y = ny THEN CAST(ceil(hm * 1.5) AS BIGINT) ELSE 2000 END || '&cl=' || x * 512 || '&ct=' || y * 512 || '&cw=' || cw || '&ch=' || ch AS url FROM c WHERE cw > 0 AND ch > 0""")
def pnav_crops(spark, sf_dir):
    img = images(spark, sf_dir).select("image_id", F.col("width").alias("source_width"), F.col("height").alias("source_height"), F.lit(1.5).cast("double").alias("ratio"), F.concat(F.lit("http://h/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("origin"))
    tiles = img.withColumn("y", F.explode(F.sequence(F.lit(0), F.floor(F.col("source_height") / 512.0).cast("int")))).withColumn("x", F.explode(F.sequence(F.lit(0), F.floor(F.col("source_width") / 512.0).cast("int"))))
    return tiles.select("image_id", "x", "y", tileurl.pnav().alias("url")).filter("url is not null")


@query(f"WITH {GRID} SELECT image_id, x, y, 'http://h/' || image_id || '/' || lpad(CAST(x AS VARCHAR), 4, '0') || '-' || y || '.jpg?c=' || x AS url FROM tiles")
def generic_template(spark, sf_dir):
    img = described(spark, sf_dir, "Generic", "http://h/").withColumn("origin", F.concat("origin", F.lit("/{{X:04}}-{{y}}.jpg?c={{x}}")))
    return tileurl.with_tile_urls(grid.plan_tiles(tileurl.with_template_parts(img, "Generic")), ["Generic"], False).select("image_id", "x", "y", "url")


@query(f"WITH {GRID} SELECT image_id, x, y, 'l3/' || lpad(CAST(y + 1 AS VARCHAR), 2, '0') || '/p_f_' || CASE WHEN x + 1 < 100 THEN lpad(CAST(x + 1 AS VARCHAR), 3, '0') ELSE CAST(x + 1 AS VARCHAR) END || '%.jpg' AS url FROM tiles")
def krpano_template(spark, sf_dir):
    img = described(spark, sf_dir, "krpano", None, url_template=F.concat(F.lit("l%l/%0v/p_%s_%00h%%."), F.lit("jpg")), base_index=F.lit(1), level_index=F.lit(3))
    return tileurl.with_tile_urls(grid.plan_tiles(tileurl.with_template_parts(img, "krpano")), ["krpano"], False).select("image_id", "x", "y", "url")


@query("SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS title FROM pages")
def html_decode(spark, sf_dir):
    """Titles with their entities decoded in one pass."""
    return read(spark, sf_dir, "pages").select("page_id", t.decode_entities(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))


LINKS = "l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages)"


@query(f"WITH {LINKS} SELECT page_id, link, count(*) AS n FROM l GROUP BY page_id, link")
def link_extract(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINKS} SELECT DISTINCT page_id, link, CASE WHEN regexp_matches(link, '[A-Za-z0-9_]*://') THEN link WHEN link LIKE '//%' THEN regexp_extract(url, '([A-Za-z0-9_]+:)', 1) || link WHEN link LIKE '/%' THEN regexp_extract(url, '((?:[A-Za-z0-9_]*://)?[^/]*/)', 1) || substr(link, 2) ELSE regexp_replace(url, '/[^/]*$', '') || '/' || link END AS resolved FROM l")
def resolve_relative(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("link")).distinct()
    return links.select("page_id", "link", t.resolve_relative(F.col("link"), F.col("url")).alias("resolved")).distinct()


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<i?frame[^>]*\\bsrc=[\"'']([^\"'']+)', 1)) AS frames FROM pages")
def frame_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.size(detect.frames_of(F.col("html"), F.col("url"))).cast("bigint").alias("frames"))


SUFFIXES = ("/ImageProperties.xml", "/a_files/12/3_4.jpg", "?FIF=x.tif", "/topview?FIF=x", "/x.pff", "/x.imgi?cmd=info", "/info.json", "/zoom/12", "/x.ecw", "/p.xml", "/WMTS?x", "/entity/OBJECT/1", "/none")
FORMATS = ("Zoomify", "Seadragon", "IIPImage", None, "Zoomify PFF", "XLimage", "IIIF", "VLS", "Hungaricana", "Mnesys", "WMTS", "pnav", None)


def _pick(values) -> str:
    return "CASE page_id % 13 " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else f"'{v}'") for k, v in enumerate(values)) + " END"


@query(f"SELECT page_id, 'http://h.example.org/' || page_id || {_pick(SUFFIXES)} AS url, {_pick(FORMATS)} AS format FROM pages")
def detect_by_url(spark, sf_dir):
    suffix = F.get(F.array(*map(F.lit, SUFFIXES)), (F.col("page_id") % 13).cast("int"))
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://h.example.org/"), F.col("page_id").cast("string"), suffix).alias("url"))
    return pages.select("page_id", "url", detect.by_url(F.col("url")).alias("format"))


MARKS = ("zoomifyImagePath=x", "dziUrlTemplate", "a?FIF=b", "zoomifyTileHandlerPath=", "\"topviews\": []", "embedpano({", "<fsi-viewer>", "data-role=\"micrio\"", "imagepath x.ecw", "naoned_viewer", "x", "y", "z")
MARKED = ("Zoomify", "Seadragon", "IIPImage", "Zoomify PFF", "TopViewer", "krpano", "FSI", "Micrio", "Hungaricana", "Mnesys", None, None, None)


@query(f"SELECT page_id, {_pick(MARKED)} AS format FROM pages")
def detect_by_content(spark, sf_dir):
    mark = F.get(F.array(*map(F.lit, MARKS)), (F.col("page_id") % 13).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", detect.by_content(F.concat("html", mark)).alias("format"))


@query("""WITH RECURSIVE n AS (SELECT page_id AS id, (SELECT count(*) FROM pages) AS total FROM pages),
  b AS (SELECT id AS root, id AS node, 0 AS level, total FROM n UNION ALL SELECT root, (node * 2 + 1) % total, level + 1, total FROM b WHERE level < 3 AND node % 13 > 9)
  SELECT root AS request_id, CASE WHEN node % 13 <= 9 THEN level END AS level FROM b b1 WHERE level = (SELECT max(level) FROM b b2 WHERE b2.root = b1.root)""")
def iframe_bfs(spark, sf_dir):
    """Pages that name no format hold a frame of another page; the level at which one does, within three."""
    pages = read(spark, sf_dir, "pages").select("page_id")
    total = pages.count()
    at = lambda c: F.concat(F.lit("http://h.example.org/p"), c.cast("string"))
    mark = F.get(F.array(*map(F.lit, MARKS)), (F.col("page_id") % 13).cast("int"))
    body = F.when(F.col("page_id") % 13 <= 9, mark).otherwise(F.concat(F.lit('<iframe src="'), at((F.col("page_id") * 2 + 1) % total), F.lit('"></iframe>')))
    found = detect.detect(pages.select(F.col("page_id").alias("request_id"), at(F.col("page_id")).alias("url")), pages.select(at(F.col("page_id")).alias("url"), body.alias("body")), depth=3)
    steps = F.lit(None).cast("int")
    here = F.regexp_extract("url", r"p(\d+)$", 1).cast("bigint")
    path = [here]
    for _ in range(3):
        path.append((path[-1] * 2 + 1) % total)
    for k in reversed(range(4)):
        steps = F.when(F.col("found_url") == at(path[k]), k).otherwise(steps)
    return found.select("request_id", steps.alias("level"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, length(props) AS n FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("bigint").alias("n"))


@query("SELECT page_id, 'a%20b%C3%A9!''()*~%26%3D%2F' || page_id AS coded, CAST(len(url) AS INTEGER) AS n FROM pages")
def uri_component(spark, sf_dir):
    text = F.concat(F.lit("a bé!'()*~&=/"), F.col("page_id").cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", t.encode_uri_component(text).alias("coded"), F.length("url").alias("n"))


@query(f"WITH {GRID} SELECT zoom, count(*) AS images, CAST(sum(nx * ny) AS BIGINT) AS tiles, CAST(max(nx * ny) AS BIGINT) AS largest FROM g GROUP BY zoom")
def tiles_by_zoom(spark, sf_dir):
    img = grid.with_defaults(images(spark, sf_dir))
    return img.groupBy("zoom").agg(F.count(F.lit(1)).alias("images"), F.sum("total_tiles").alias("tiles"), F.max("total_tiles").alias("largest"))


@query("SELECT p_partkey AS image_id, least(sqrt(268435456 / (CAST(64 + (p_partkey * 7919) % 40000 AS DOUBLE) * (64 + (p_partkey * 104729) % 30000))), 1.0) AS ratio FROM part")
def canvas_ratio(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("image_id"), grid.canvas_ratio(64 + (k * 7919) % 40000, 64 + (k * 104729) % 30000).alias("ratio"))


@query("""WITH o AS (SELECT o_orderkey AS image_id, CAST(1 + o_orderkey % 7 AS BIGINT) AS total_tiles FROM orders),
  r AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS loaded, count(*) FILTER (l_returnflag = 'R') AS failed, arg_min(CASE WHEN l_returnflag = 'R' THEN 'line ' || l_linenumber END, l_linenumber) FILTER (l_returnflag = 'R') AS first_error FROM lineitem GROUP BY l_orderkey)
  SELECT image_id, total_tiles, coalesce(loaded, 0) AS loaded, coalesce(failed, 0) AS failed, coalesce(loaded, 0) >= total_tiles AS done, first_error FROM o LEFT JOIN r ON l_orderkey = image_id""")
def run_progress(spark, sf_dir):
    """Orders as images, their lines as tile results; returned lines failed."""
    from tessera.operators.mosaic import progress

    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), (1 + F.col("o_orderkey") % 7).alias("total_tiles"))
    failed = F.col("l_returnflag") == "R"
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("seq"), F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).alias("error"))
    return progress(orders, lines)


@query()
def mosaic_checksum(spark, sf_dir):
    """One-coloured tiles of all images painted and summed."""
    from tessera.operators.mosaic import mosaic

    # The table is a few MB, which one task would read and make all tiles of.
    dealt = images(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "image_id")
    tiles = grid.plan_tiles(dealt.withColumn("overlap", F.lit(1)))
    sides = [F.least(F.col("tile_size") + 1, F.col(s) - F.col(p)).cast("int") for s, p in (("width", "px"), ("height", "py"))]
    colour = F.unhex(F.lpad(F.hex(F.col("image_id") * 31 + F.col("tile_index") * 7), 6, "0"))
    tiles = tiles.withColumns({"tile_w": sides[0], "tile_h": sides[1]}).withColumn("data", colour)
    return mosaic(tiles.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), "px", "py", "tile_w", "tile_h", "data"), digest=True)


# --- from pages to tiles

SITE = "http://h.example.org/"


def _numbered(parts, k: str = "image_id"):
    """A text with the image's number between the parts."""
    return F.concat(*[c for i, p in enumerate(parts) for c in ([F.col(k).cast("string")] if i else []) + [p if not isinstance(p, str) else F.lit(p)]])


@query(f"""WITH {IMG}, f AS (SELECT *, image_id % 9 AS k FROM img)
  SELECT image_id, CASE k WHEN 0 THEN 'Zoomify' WHEN 1 THEN 'Seadragon' WHEN 2 THEN 'IIIF' WHEN 3 THEN 'IIPImage' WHEN 4 THEN 'XLimage' WHEN 5 THEN 'FSI' WHEN 6 THEN 'Mnesys' WHEN 7 THEN 'Generic' END AS format,
    CASE WHEN k < 7 THEN width END AS width, CASE WHEN k < 7 THEN height END AS height, CASE WHEN k = 5 THEN 512 WHEN k < 7 THEN 240 END AS tile_size, k >= 7 AS failed FROM f""")
def parse_descriptors(spark, sf_dir):
    """Metadata documents of seven formats, one that needs probes and one of no format, made from the images' sizes."""
    from tessera.operators.parse import parse

    w, h = F.col("width").cast("string"), F.col("height").cast("string")
    bodies = {
        "Zoomify": F.concat(F.lit('<IMAGE_PROPERTIES WIDTH="'), w, F.lit('" HEIGHT="'), h, F.lit('" NUMTILES="9" TILESIZE="240"/>')), "Seadragon": F.concat(F.lit('<Image TileSize="240" Overlap="1" Format="png"><Size Width="'), w, F.lit('" Height="'), h, F.lit('"/></Image>')),
        "IIIF": F.concat(F.lit('{"@id": "http://i.example.org/x", "width": '), w, F.lit(', "height": '), h, F.lit(', "tiles": [{"width": 240, "scaleFactors": [1, 2]}]}')), "IIPImage": F.concat(F.lit("Max-size:"), w, F.lit(" "), h, F.lit("\nTile-size:240 240\nResolution-number:3\n")),
        "XLimage": F.concat(F.lit("<image><width>"), w, F.lit("</width><height>"), h, F.lit("</height><tileside>240</tileside></image>")), "FSI": F.concat(F.lit('<i><width value="'), w, F.lit('"/><height value="'), h, F.lit('"/></i>')),
        "Mnesys": F.concat(F.lit('<p><layer z="1" w="9" h="9" t="240"/><layer z="7" w="'), w, F.lit('" h="'), h, F.lit('" t="240"/></p>')), "Generic": F.lit(""),
    }
    k, name, body = F.col("image_id") % 9, F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (n, b) in enumerate(bodies.items()):
        name, body = F.when(k == i, n).otherwise(name), F.when(k == i, b).otherwise(body)
    docs = images(spark, sf_dir).select(F.col("image_id").alias("request_id"), _numbered((SITE, "/server?source=a&FIF=b/info.json")).alias("url"), name.alias("format"), body.alias("body"))
    out = parse(docs, [n for n in bodies if n != "Generic"])
    return out.select(F.col("request_id").alias("image_id"), "format", "width", "height", F.col("tile_size").cast("int"), F.col("error").isNotNull().alias("failed"))


@query(f"""WITH f AS (SELECT page_id, page_id % 9 AS k, '{SITE}' || page_id AS site FROM pages)
  SELECT page_id, CASE k WHEN 0 THEN site || '/ImageProperties.xml' WHEN 1 THEN site || '.dzi' WHEN 2 THEN '{SITE}zoom/' || page_id WHEN 3 THEN '{SITE}i/' || page_id || '/ImageProperties.xml' WHEN 4 THEN site || 'e.dzi' WHEN 5 THEN '{SITE}digital/iiif/' || page_id || '/info.json' WHEN 6 THEN 'http://i.example.org/' || page_id || '/info.json' END AS meta_url,
    CASE k WHEN 7 THEN site || '/gone' END AS needs_url, k = 8 AS failed FROM f""")
def discover_urls(spark, sf_dir):
    """Rewritten URLs, pages that name their document, a record to read first, a page that is not there, and no format."""
    from tessera.operators.discover import discover

    kinds = [
        ("Zoomify", "/TileGroup0/2-1-0.jpg", None), ("Seadragon", "_files/9/1_1.jpg", None), ("VLS", None, None), ("Zoomify", "/z", ('zoomifyImagePath=/i/', '&amp;x')), ("Seadragon", "/s", (f"Seadragon.embed('9', '{SITE}", "e.dzi')")),
        ("IIIF", None, None), ("IIIF", "/i", ('<a href="http://i.example.org/', '/full/full/0/default.jpg">')), ("krpano", "/gone", None), (None, "/none", None),
    ]
    k = F.col("page_id") % len(kinds)
    name, at, body = (F.lit(None).cast("string") for _ in range(3))
    for i, (n, end, marks) in enumerate(kinds):
        url = _numbered((SITE, end), "page_id") if end else _numbered((f"{SITE}pageview/", ""), "page_id") if n == "VLS" else _numbered((f"{SITE}digital/collection/c/id/", ""), "page_id")
        name, at = F.when(k == i, F.lit(n)).otherwise(name), F.when(k == i, url).otherwise(at)
        body = F.when(k == i, _numbered(marks, "page_id")).otherwise(body) if marks else body
    rows = read(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("request_id"), at.alias("url"), name.alias("format"), body.alias("body"))
    records = rows.filter(k == 5).select(_numbered((f"{SITE}digital/api/singleitem/collection/c/id/", ""), "page_id").alias("url"), _numbered(('{"iiifInfoUri": "/iiif/', '/info.json"}'), "page_id").alias("body"))
    documents = rows.filter("body is not null").select("url", "body").unionByName(records)
    found = discover(rows.select("request_id", "url", "format"), documents, ["Zoomify", "Seadragon", "VLS", "IIIF", "krpano"])
    return found.select(F.col("request_id").alias("page_id"), "meta_url", "needs_url", F.col("error").isNotNull().alias("failed"))


@query(f"""WITH p AS (SELECT page_id, page_id % 7 AS k, '{SITE}' || page_id AS site, 64 + (page_id * 7919) % 1500 AS width, 64 + (page_id * 104729) % 1200 AS height FROM pages),
  g AS (SELECT *, CAST(ceil(width / 256.0) AS INTEGER) AS nx, CAST(ceil(height / 256.0) AS INTEGER) AS ny FROM p WHERE k < 4),
  gy AS (SELECT *, CAST(unnest(range(0, ny)) AS INTEGER) AS y FROM g), t AS (SELECT *, CAST(unnest(range(0, nx)) AS INTEGER) AS x FROM gy)
  SELECT page_id, CASE k WHEN 0 THEN 'Seadragon' WHEN 2 THEN 'IIIF' ELSE 'Zoomify' END AS format, x, y, x * 256 - CASE WHEN k = 0 AND x > 0 THEN 1 ELSE 0 END AS px, y * 256 - CASE WHEN k = 0 AND y > 0 THEN 1 ELSE 0 END AS py,
    CASE k WHEN 0 THEN site || '_files/' || CAST(ceil(log2(greatest(width, height))) AS INTEGER) || '/' || x || '_' || y || '.png'
      WHEN 2 THEN '{SITE}iiif/' || page_id || '/' || x * 256 || ',' || y * 256 || ',' || least(256, width - x * 256) || ',' || least(256, height - y * 256) || '/' || least(256, width - x * 256) || ',' || least(256, height - y * 256) || '/0/default.jpg'
      ELSE site || CASE k WHEN 3 THEN '/inner' ELSE '' END || '/TileGroup0/' || CAST(ceil(ln(greatest(width, height) / CAST(CASE WHEN greatest(width, height) > 256 THEN 257 ELSE 256 END AS DOUBLE)) / ln(CAST(2 AS DOUBLE))) AS INTEGER) || '-' || x || '-' || y || '.jpg' END AS url, NULL AS failed_at FROM t
  UNION ALL SELECT page_id, CASE k WHEN 4 THEN NULL ELSE 'Seadragon' END, NULL, NULL, NULL, NULL, NULL, CASE k WHEN 4 THEN 'detect' WHEN 5 THEN 'fetch' ELSE 'parse' END FROM p WHERE k >= 4""")
def crawl_to_tiles(spark, sf_dir):
    """All steps from requested URLs to tiles: by the URL, by the page and by its frame, and pages that fail at each step."""
    from tessera.plans import crawl

    k = F.col("page_id") % 7
    own = read(spark, sf_dir, "pages").select("page_id", k.alias("k"), (64 + (F.col("page_id") * 7919) % 1500).alias("width"), (64 + (F.col("page_id") * 104729) % 1200).alias("height"))
    at = lambda *parts: _numbered(parts, "page_id")
    w, h = F.col("width").cast("string"), F.col("height").cast("string")
    count = (F.ceil(F.col("width") / 256.0) * F.ceil(F.col("height") / 256.0)).cast("string")
    dzi = F.concat(F.lit('<Image TileSize="256" Overlap="1" Format="png"><Size Width="'), w, F.lit('" Height="'), h, F.lit('"/></Image>'))
    zoomify = F.concat(F.lit('<IMAGE_PROPERTIES WIDTH="'), w, F.lit('" HEIGHT="'), h, F.lit('" NUMTILES="'), count, F.lit('" TILESIZE="256"/>'))
    info = F.concat(F.lit('{"@context": "http://iiif.io/api/image/2/context.json", "@id": "'), at(f"{SITE}iiif/", ""), F.lit('", "width": '), w, F.lit(', "height": '), h, F.lit(', "tiles": [{"width": 256, "scaleFactors": [1]}]}'))
    embed = at(f"<script>Seadragon.embed('9', '{SITE}", ".dzi')</script>")
    # Of each kind of page: the URL that is asked for, and the documents of the crawl.
    kinds = [
        (at(SITE, "/view"), [(at(SITE, "/view"), embed), (at(SITE, ".dzi"), dzi)]),
        (at(SITE, "/TileGroup0/2-1-0.jpg"), [(at(SITE, "/ImageProperties.xml"), zoomify)]),
        (at(f"{SITE}iiif/", "/info.json"), [(at(f"{SITE}iiif/", "/info.json"), info)]),
        (at(SITE, "/outer"), [(at(SITE, "/outer"), at('<iframe src="/', '/frame"></iframe>')), (at(SITE, "/frame"), at("zoomifyImagePath=/", "/inner&amp;x")), (at(SITE, "/inner/ImageProperties.xml"), zoomify)]),
        (at(SITE, "/none"), [(at(SITE, "/none"), F.lit("<p>No image</p>"))]),
        (at(SITE, "/lost"), [(at(SITE, "/lost"), embed)]),
        (at(SITE, "/bad"), [(at(SITE, "/bad"), embed), (at(SITE, ".dzi"), F.lit("<Image/>"))]),
    ]
    asked, held = F.lit(None).cast("string"), F.array().cast("array<struct<url:string,body:string>>")
    for i, (url, docs) in enumerate(kinds):
        asked = F.when(k == i, url).otherwise(asked)
        held = F.when(k == i, F.array(*(F.struct(u.alias("url"), b.alias("body")) for u, b in docs))).otherwise(held)
    formats = ["Zoomify", "Seadragon", "IIIF"]
    described = crawl.describe(own.select(F.col("page_id").alias("request_id"), asked.alias("url")), own.select(F.inline(held)), formats)
    planned = crawl.tiles(described, formats).select(F.col("request_id").alias("page_id"), "format", "x", "y", "px", "py", "url", "failed_at")
    failed = described.filter("failed_at is not null").select(F.col("request_id").alias("page_id"), "format", "failed_at")
    return planned.unionByName(failed, allowMissingColumns=True)


def queries() -> dict:
    from tessera.plans import walks  # noqa: F401  it registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
