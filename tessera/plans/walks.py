"""Queries over walks from document to document, over rule indexes, and over painted and coded images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.plans.queries import SITE, query, read

#: Width and height of the image that belongs to a number, here and in SQL.
WIDE, HIGH = (lambda k: 64 + (k * 7919) % 1500), (lambda k: 64 + (k * 104729) % 1200)


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _documents(pages, kinds):
    """(url, body) from pages and lists of (condition, url, body)."""
    held = F.concat(*(F.when(c & url.isNotNull(), F.array(F.struct(url.alias("url"), body.alias("body")))).otherwise(F.array().cast("array<struct<url:string,body:string>>")) for c, url, body in kinds))
    return pages.select(F.inline(held))


@query(f"""WITH RECURSIVE n AS (SELECT page_id AS id, page_id % 4 AS k, (SELECT count(*) FROM pages) AS total FROM pages),
  scenes AS (SELECT id AS root, id AS node, [id] AS seen, total FROM n WHERE k = 0
    UNION ALL SELECT root, (node * 2 + 1) % total, list_append(seen, (node * 2 + 1) % total), total FROM scenes WHERE node % 5 > 2 AND node % 11 <> 7 AND NOT list_contains(seen, (node * 2 + 1) % total)),
  ends AS (SELECT root, arg_max(node, len(seen)) AS node FROM scenes GROUP BY root),
  a AS (SELECT id, k, CASE k WHEN 0 THEN node ELSE id END AS spot, CASE k WHEN 0 THEN node % 11 = 7 WHEN 1 THEN id % 7 = 0 WHEN 2 THEN id % 9 = 2 ELSE false END AS gone, CASE k WHEN 0 THEN node % 5 > 2 AND node % 11 <> 7 ELSE false END AS bare, k = 3 AND id % 12 = 3 AS circle FROM n LEFT JOIN ends ON root = id)
  SELECT id AS page_id, CASE WHEN circle THEN NULL ELSE CASE k WHEN 0 THEN 'krpano' WHEN 1 THEN 'Zoomify PFF' WHEN 2 THEN 'Zoomify' ELSE 'Seadragon' END END AS format,
    CASE WHEN circle THEN 'detect' WHEN gone THEN 'fetch' WHEN bare THEN 'parse' END AS failed_at,
    CASE WHEN gone THEN CASE k WHEN 2 THEN '{SITE}' || id || '/' || (1 + id % 6) WHEN 0 THEN '{SITE}scenes/' || spot || '.xml' WHEN 1 THEN '{SITE}t?file=' || id || '.pff&requestType=2&begin=' || (1060 + id % 40) || '&end=' || (1060 + id % 40 + 8 * (1 + id % 5)) END END AS needs_url,
    CASE WHEN NOT (circle OR gone OR bare) THEN CAST(64 + (spot * 7919) % 1500 AS BIGINT) END AS width, CASE WHEN NOT (circle OR gone OR bare) THEN CAST(64 + (spot * 104729) % 1200 AS BIGINT) END AS height FROM a""")
def metadata_walks(spark, sf_dir):
    """Requests whose geometry is some documents away, from page to descriptor.

    Scenes that include scenes, up to the first with levels, some in circles or over documents that aren't there; tile
    files whose index is a second request; pages whose image is in a frame of a frame, up to six deep, of the format
    itself or of an unknown page before its format is known; and frames that lead round.
    """
    from tessera.plans import crawl

    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    total = pages.count()
    k, kind = F.col("id"), F.col("id") % 4
    w, h = WIDE(k).cast("string"), HIGH(k).cast("string")
    scene = lambda n: _text(f"{SITE}scenes/", n, ".xml")
    levels = _text('<krpano><image><cube url="a_%v_%h.jpg" multires="64,', w, "x", h, '"/></image></krpano>')
    include = _text('<krpano><include url="', (k * 2 + 1) % total, '.xml"/></krpano>')
    tiles = (1 + k % 5).cast("string")
    begin = 1060 + k % 40
    file = _text(f"{SITE}t?file=", k, ".pff")
    header = _text('reply_data=<PFF WIDTH="', w, '" HEIGHT="', h, '" TILESIZE="64" NUMTILES="', tiles, '" HEADERSIZE="', k % 40, '"/>')
    index = _text(file, "&requestType=2&begin=", begin, "&end=", begin + 8 * (1 + k % 5))
    offsets = _text("reply_data=9000,", F.repeat(F.lit("      100"), (1 + k % 5).cast("int")))
    own = lambda d: _text(SITE, k, f"/{d}")
    frame = lambda d: _text('<iframe src="', own(d), '"></iframe>')
    dzi = _text('<Image TileSize="64" Overlap="0" Format="png"><Size Width="', w, '" Height="', h, '"/></Image>')
    properties = _text('<IMAGE_PROPERTIES WIDTH="', w, '" HEIGHT="', h, '" NUMTILES="1" TILESIZE="64"/>')
    held = [
        (kind == 0, _text(SITE, k, "/pano"), _text("embedpano({xml: '", scene(k), "'})")),
        (k % 11 != 7, scene(k), F.when(k % 5 > 2, include).otherwise(levels)),
        (kind == 1, _text(file, "&requestType=1"), header), ((kind == 1) & (k % 7 != 0), index, offsets),
        (kind == 2, own(0), _text("type: 'zoomifytileservice' ", frame(1))), (kind == 2, _text(SITE, k, "/image/ImageProperties.xml"), properties),
        ((kind == 3) & (k % 12 != 3), _text(SITE, k, ".dzi"), dzi),
    ]
    for d in range(1, 7):
        deep = 1 + k % 6
        # The last page of a chain is in no crawl for one in nine, leads nowhere but back for one in three of the other kind.
        last = F.when(kind == 2, _text("zoomifyImagePath=/", k, "/image&")).when(k % 12 == 3, frame(1)).otherwise(_text("Seadragon.embed('1', '", SITE, k, ".dzi')"))
        held.append(((kind > 1) & (deep >= d) & ~((kind == 2) & (k % 9 == 2) & (deep == d)), own(d), F.when(deep == d, last).otherwise(frame(d + 1))))
    held.append((kind == 3, own(0), frame(1)))
    url = F.when(kind == 0, _text(SITE, k, "/pano")).when(kind == 1, _text(file, "&requestType=1")).otherwise(own(0))
    formats = ["krpano", "Zoomify PFF", "Zoomify", "Seadragon"]
    out = crawl.describe(pages.select(k.alias("request_id"), url.alias("url")), _documents(pages, held), formats)
    good = F.col("failed_at").isNull()
    return out.select(F.col("request_id").alias("page_id"), "format", "failed_at", "needs_url", *(F.when(good, F.col(c)).alias(c) for c in ("width", "height")))


@query("""WITH t AS (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN ' shipped from ' || (SELECT n_name FROM nation WHERE n_nationkey = page_id % 25) || '.' WHEN page_id % 3 = 1 THEN ' to ' || (SELECT r_name FROM region WHERE r_regionkey = page_id % 5) || 'N' ELSE ' x' END AS text FROM pages),
  r AS (SELECT n_nationkey AS rule, 'nation' AS format, n_name AS name FROM nation UNION ALL SELECT 100 + r_regionkey, 'region', r_name FROM region),
  m AS (SELECT page_id, min(rule) AS rule FROM t, r WHERE regexp_matches(text, CASE format WHEN 'nation' THEN '\\b' || name || '\\b' ELSE '(to|from) ' || name END) GROUP BY page_id)
  SELECT page_id, CASE WHEN rule < 100 THEN 'nation' WHEN rule IS NOT NULL THEN 'region' END AS format, CAST(rule AS INTEGER) AS rule FROM pages LEFT JOIN m USING (page_id)""")
def rule_index(spark, sf_dir):
    """Rules from two tables against whole pages: the first that matches, of candidates that one pass over a page names."""
    from tessera.operators.detect import by_index
    from tessera.operators.ruleindex import Rule, RuleIndex

    # Rules are a bounded list, as detection's own are: one for each nation and region.
    nations, regions = ({r[0]: r[1] for r in read(spark, sf_dir, t).select(f"{t[0]}_{t}key", f"{t[0]}_name").collect()} for t in ("nation", "region"))
    rules = [Rule(n, "nation", rf"\b{name}\b") for n, name in nations.items()] + [Rule(100 + n, "region", f"(to|from) {name}") for n, name in regions.items()]
    at = lambda names, n: F.element_at(F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, v))), (F.col("page_id") % n).cast("int"))
    k = F.col("page_id") % 3
    tail = F.when(k == 0, _text(" shipped from ", at(nations, 25), ".")).when(k == 1, _text(" to ", at(regions, 5), "N")).otherwise(F.lit(" x"))
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat("html", tail).alias("text"))
    return by_index(pages, RuleIndex(rules), "text").select("page_id", "format", "rule")


#: Images of pages, in tiles of 32 pixels of one grey each.
GREYS = """img AS (SELECT page_id, 24 + (page_id * 7919) % 120 AS width, 24 + (page_id * 104729) % 90 AS height FROM pages),
  g AS (SELECT *, CAST(ceil(width / 32.0) AS INTEGER) AS nx, CAST(ceil(height / 32.0) AS INTEGER) AS ny FROM img),
  gy AS (SELECT *, CAST(unnest(range(0, ny)) AS INTEGER) AS y FROM g), tiles AS (SELECT *, CAST(unnest(range(0, nx)) AS INTEGER) AS x FROM gy),
  t AS (SELECT *, least(32, width - 32 * x) AS tw, least(32, height - 32 * y) AS th, (page_id * 31 + (y * nx + x) * 7) % 256 AS grey FROM tiles)"""


def _grey_tiles(spark, sf_dir):
    from tessera.operators import grid

    k = F.col("page_id")
    images = read(spark, sf_dir, "pages").select(k.alias("image_id"), (24 + (k * 7919) % 120).cast("int").alias("width"), (24 + (k * 104729) % 90).cast("int").alias("height"), F.lit(32).alias("tile_size"))
    tiles = grid.plan_tiles(images)
    sides = [F.least(F.col("tile_size"), F.col(s) - F.col(p)).cast("int").alias(n) for s, p, n in (("width", "px", "tile_w"), ("height", "py", "tile_h"))]
    return tiles.select("image_id", "width", "height", "px", "py", *sides, ((F.col("image_id") * 31 + F.col("tile_index") * 7) % 256).cast("int").alias("grey"))


def _brightness():
    """The sum of all bytes."""

    def of(data: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(x, np.uint8).sum(dtype=np.int64)) for x in data])

    return F.pandas_udf(of, "long")


@query(f"""WITH {GREYS}, r AS (SELECT *, least(sqrt(3000 / (CAST(width AS DOUBLE) * height)), 1.0) AS r FROM t),
  c AS (SELECT *, floor(width * r) AS cw, floor(height * r) AS ch, floor(32 * x * r) AS dx, floor(32 * y * r) AS dy FROM r),
  v AS (SELECT *, CASE WHEN x + 1 < nx THEN floor(32 * (x + 1) * r) ELSE cw END - dx AS vw, CASE WHEN y + 1 < ny THEN floor(32 * (y + 1) * r) ELSE ch END - dy AS vh FROM c)
  SELECT page_id, CAST(any_value(cw) AS INTEGER) AS width, CAST(any_value(ch) AS BIGINT) AS height, CAST(sum(3 * grey * vw * vh) AS BIGINT) AS brightness FROM v GROUP BY page_id""")
def scaled_mosaic(spark, sf_dir):
    """Images painted smaller, to fit a canvas of 3,000 pixels, in strips; later tiles cover earlier ones by a pixel."""
    from tessera.operators.mosaic import mosaic

    grey = F.lpad(F.hex("grey"), 2, "0")
    tiles = _grey_tiles(spark, sf_dir).withColumn("data", F.unhex(F.concat(grey, grey, grey)))
    strips = mosaic(tiles, strip=32, area=3_000)
    return strips.withColumn("sum", _brightness()("data")).groupBy(F.col("image_id").alias("page_id")).agg(F.max("width").alias("width"), F.sum("height").alias("height"), F.sum("sum").alias("brightness"))


@query(f"WITH {GREYS} SELECT page_id, any_value(width) AS width, any_value(height) AS height, CAST(sum(3 * grey * tw * th) AS BIGINT) AS brightness FROM t GROUP BY page_id")
def jpeg_mosaic(spark, sf_dir):
    """JPEG tiles painted in strips and written as a JPEG file for each image, which is read back.

    Tiles of one grey lose nothing: they begin at multiples of 8, and a brightness alone is a multiple of its quantiser.
    """
    from tessera.operators.mosaic import mosaic, with_sizes
    from tessera.sources import documents, jpeg
    from tessera.sources.shared import Written

    def coded(grey: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        known: dict = {}  # a task's tiles are few different ones
        keys = list(zip(grey, width, height, strict=True))
        for g, w, h in keys:
            if (g, w, h) not in known:
                known[g, w, h] = jpeg.encode(np.full((h, w, 3), g, np.uint8))
        return pd.Series([known[k] for k in keys])

    def decoded(data: pd.Series) -> pd.Series:
        return pd.Series([jpeg.decode(x).tobytes() for x in data])

    tiles = _grey_tiles(spark, sf_dir).withColumn("data", F.pandas_udf(coded, "binary")("grey", "tile_w", "tile_h")).drop("tile_w", "tile_h", "grey")
    tables = Written(spark, "jpeg")
    folder = f"{tables.root}/files"
    written = tables.put(documents.write_jpegs(mosaic(with_sizes(tiles), strip=64), folder), "written")
    files = documents.read_files(written, folder)
    sized = with_sizes(files.select(F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("long").alias("page_id"), "data"))
    return sized.select("page_id", F.col("tile_w").cast("long").alias("width"), F.col("tile_h").cast("long").alias("height"), _brightness()(F.pandas_udf(decoded, "binary")("data")).alias("brightness"))


#: A key of no site, for tests of signing.
KEY = b"a key of no site at all, for signing the paths of a table's images and of nothing else"


def _pads() -> tuple[str, str]:
    import hashlib

    block = hashlib.sha1(KEY).digest().ljust(64, b"\0")
    return tuple("from_hex('" + bytes(c ^ p for c in block).hex() + "')" for p in (0x36, 0x5C))


@query(f"""WITH {GREYS}, m AS (SELECT page_id, x, y, 'maps/' || page_id || '=x' || x || '-y' || y || '-z' || greatest(0, CAST(ceil(ln(greatest(width, height) / CAST(32 AS DOUBLE)) / ln(CAST(2 AS DOUBLE))) AS INTEGER)) || '-t' AS head, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'tok' || page_id END AS token FROM t)
  SELECT page_id, x, y, 'https://s.example.org/' || head || replace(translate(base64(from_hex(sha1({_pads()[1]} || from_hex(sha1({_pads()[0]} || encode(head || token)))))), '+/', '__'), '=', '') AS url FROM m""")
def signed_urls(spark, sf_dir):
    """Tile URLs signed by HMAC-SHA1, in the row."""
    from tessera.operators import grid, tileurl

    k = F.col("page_id")
    images = read(spark, sf_dir, "pages").select(k, (24 + (k * 7919) % 120).alias("width"), (24 + (k * 104729) % 90).alias("height"), F.lit(32).alias("tile_size"))
    images = images.withColumns({"format": F.lit("Arts & Culture"), "origin": _text("https://s.example.org/maps/", k, "=g"), "token": F.when(k % 3 > 0, _text("tok", k))})
    tiles = grid.plan_tiles(images).withColumn("zoom", F.greatest(F.lit(0), F.col("zoom")))
    return tileurl.with_tile_urls(tiles, ["Arts & Culture"], keys={"Arts & Culture": KEY}).select("page_id", "x", "y", "url")


@query("""WITH u AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL), h AS (SELECT url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM u), n AS (SELECT host, count(*) AS n FROM h GROUP BY host)
  SELECT url, host, n AS requests, CAST(least(n, 16) AS INTEGER) AS lanes, true AS good, CASE WHEN n > 16 THEN 3.2::DOUBLE END AS spacing, n AS places, (n - 1) / 5.0::DOUBLE AS last_due FROM h JOIN n USING (host)""")
def fetch_schedule(spark, sf_dir):
    """When the URLs of pages are due: each has a place of its own in its host's order, and lanes of equal spacing."""
    from tessera.sources.pacing import schedule
    from tessera.sources.shared import Written

    due = Written(spark, "schedule").put(schedule(read(spark, sf_dir, "pages").select("url")), "due")
    # Lanes go by turns, so the spacing of a lane is that of places `lanes` apart.
    later = due.select("host", (F.col("place") - F.col("lanes")).alias("place"), (F.col("due")).alias("next_due"), F.col("lane").alias("next_lane"))
    spaced = due.join(later, ["host", "place"], "left")
    good = (F.col("due") == F.col("place") / 5.0) & (F.col("lane") == F.col("place") % F.col("lanes")) & F.coalesce(F.col("lane") == F.col("next_lane"), F.lit(True)) & F.col("place").between(0, F.col("n") - 1)
    hosts = spaced.groupBy("host").agg(F.count_distinct("place").alias("places"), F.max("due").alias("last_due"), F.max(F.round(F.col("next_due") - F.col("due"), 6)).alias("most"), F.min(F.round(F.col("next_due") - F.col("due"), 6)).alias("least"))
    hosts = hosts.select("host", "places", "last_due", F.when(F.col("most") == F.col("least"), F.col("most")).alias("spacing"))
    return spaced.join(hosts, "host").select("url", "host", F.col("n").alias("requests"), "lanes", good.alias("good"), "spacing", "places", "last_due")


@query("""SELECT page_id, CAST((1 + (page_id * 37) % 1000) * tile AS BIGINT) AS width, CAST((1 + (page_id * 101) % 700) * tile AS BIGINT) AS height, tile AS tile_size
  FROM (SELECT *, CASE WHEN page_id % 4 = 0 AND 1 + (page_id * 37) % 1000 > 600 THEN 512 ELSE 256 END AS tile FROM pages)""")
def grid_search(spark, sf_dir):
    """Sizes of images whose tiles follow a template, found by ten rounds of probes for all images at once.

    A tile exists if its place is within the image that its number stands for; some images have larger tiles.
    """
    from tessera.operators.search import search_grids

    def probe(urls):
        number = lambda k: F.regexp_extract("url", r"/(\d+)/(\d+)-(\d+)\.jpg$", k).cast("long")
        k, x, y = number(1), number(2), number(3)
        wide, high = 1 + (k * 37) % 1000, 1 + (k * 101) % 700
        side = F.when((k % 4 == 0) & (wide > 600), 512).otherwise(256)
        return urls.select("url", ((x < wide) & (y < high)).alias("ok"), side.alias("width"), side.alias("height"))

    images = read(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), _text("http://h.example.org/", F.col("page_id"), "/{{x}}-{{Y}}.jpg").alias("url"))
    return search_grids(images, probe).select(F.col("request_id").alias("page_id"), "width", "height", "tile_size")


@query(f"""WITH {GREYS}, p AS (SELECT *, x * 32 - CASE WHEN x > 0 THEN 1 ELSE 0 END AS px, y * 32 - CASE WHEN y > 0 THEN 1 ELSE 0 END AS py FROM t)
  SELECT page_id, x, y, CAST(y * nx + x AS BIGINT) AS tile_index, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, CAST(least((x + 1) * 32 + 1, width) - px AS INTEGER) AS tile_w, CAST(least((y + 1) * 32 + 1, height) - py AS INTEGER) AS tile_h FROM p""")
def sql_tile_grid(spark, sf_dir):
    """The tile grid as a function of SQL."""
    from tessera.operators.formats import register_sql

    register_sql(spark)
    pages = read(spark, sf_dir, "pages")
    return spark.sql("SELECT page_id, t.* FROM (SELECT page_id, tile_grid(24 + (page_id * 7919) % 120, 24 + (page_id * 104729) % 90, 32, 1) AS tiles FROM {pages}), LATERAL inline(tiles) AS t", pages=pages)


@query("""WITH p AS (SELECT page_id, page_id % 9 AS k, CAST(64 + (page_id * 7919) % 1500 AS BIGINT) AS w, CAST(64 + (page_id * 104729) % 1200 AS BIGINT) AS h FROM pages)
  SELECT page_id, CASE k WHEN 0 THEN 'TopViewer' WHEN 1 THEN 'krpano' WHEN 2 THEN 'Zoomify PFF' WHEN 3 THEN 'LizardTech' WHEN 4 THEN 'VLS' WHEN 5 THEN 'Micrio' WHEN 6 THEN 'Arts & Culture' WHEN 7 THEN 'Hungaricana' ELSE 'WMTS' END AS format,
    CASE k WHEN 8 THEN ((503 + 10 * w) // 1000 + 1) * 128 ELSE w END AS width, CASE k WHEN 4 THEN ((h - 1) // 400 + 1) * 400 WHEN 8 THEN ((503 + 10 * h) // 1000 + 1) * 128 ELSE h END AS height,
    CASE k WHEN 0 THEN 240 WHEN 1 THEN 80 WHEN 2 THEN 100 WHEN 4 THEN 1024 WHEN 6 THEN 100 WHEN 8 THEN 128 ELSE 512 END AS tile_size,
    CASE k WHEN 0 THEN '/tv/f' || page_id || '/{tile}.jpg' WHEN 1 THEN 'b_%v.jpg' WHEN 2 THEN (9000 + page_id % 90) || ',' || (1060 + 8 * (1 + page_id % 5)) WHEN 3 THEN 'c' || page_id || ',d/n' WHEN 4 THEN '/image/tiler/square/o' || page_id || '/0' WHEN 5 THEN 'u' || page_id WHEN 6 THEN '1' WHEN 7 THEN 'm' || page_id || '.ecw' ELSE '0,' || ((503 + 10 * w) // 1000) END AS detail, false AS failed FROM p""")
def parse_more_descriptors(spark, sf_dir):
    """Metadata documents of the nine formats that parse_descriptors() leaves, and of each something that its URLs need."""
    from tessera.operators.parse import parse

    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    n, k = F.col("id"), F.col("id") % 9
    w, h = WIDE(n), HIGH(n)
    sides = [F.ceil(s / F.lit(100.0)).cast("long") for s in (w, h)]
    matrix = "<TileMatrix><ows:Identifier>{0}</ows:Identifier><ScaleDenominator>{1!r}</ScaleDenominator><TopLeftCorner>0 1000000</TopLeftCorner><TileWidth>128</TileWidth><TileHeight>128</TileHeight></TileMatrix>"
    matrices = matrix.format("far", 4000 / (128 * 0.00028)) + matrix.format("near", 1000 / (128 * 0.00028))
    bodies = {
        "TopViewer": _text('{"config": {"tileurl_v2": "/tv/{file}/{tile}.{extension}"}, "topviews": [{"filepath": "f', n, '", "width": ', w, ', "height": ', h, ', "tileWidth": 240, "layers": [{"no": 0, "width": 9, "starttile": 5, "cols": 1}, {"no": 1, "width": ', w, ', "starttile": 20, "cols": 2}]}]}'),
        "krpano": _text('<krpano><image baseindex="0"><flat url="a_%v.jpg" multires="80,20x20"/><cube url="b_%v.jpg" multires="60,30x30,', w, "x", h, 'x80"/></image></krpano>'),
        "Zoomify PFF": _text('reply_data=<PFF WIDTH="', w, '" HEIGHT="', h, '" TILESIZE="100" NUMTILES="', 1 + n % 5, '" HEADERSIZE="0"/>\nreply_data=9000,       40', F.lpad((n % 90).cast("string"), 9, " ")),
        "LizardTech": _text('<ImageServer><Catalog name="c', n, '"/><Image width="', w, '" height="', h, '" name="n" parent="d"/></ImageServer>'),
        "VLS": _text('<html xmlns:vls="urn:v"><div id="map" vls:height="', h, '" vls:width="', w, '" vls:ot_id="o', n, '"/><var id="zoomTileSize" value="400"/></html>'),
        "Micrio": _text('{"levels": [{"width": 9, "height": 9, "tiles": []}, {"width": ', w, ', "height": ', h, ', "tiles": [{"x": 0, "y": 0, "url": "old"}, {"x": 0, "y": 0, "url": "u', n, '"}]}]}'),
        "Arts & Culture": _text('<TileInfo tile_width="100" tile_height="100"><pyramid_level num_tiles_x="1" num_tiles_y="1" empty_pels_x="0" empty_pels_y="0"/><pyramid_level num_tiles_x="', sides[0], '" num_tiles_y="', sides[1], '" empty_pels_x="', sides[0] * 100 - w, '" empty_pels_y="', sides[1] * 100 - h, '"/><pyramid_level num_tiles_x="900" num_tiles_y="900" empty_pels_x="0" empty_pels_y="0"/></TileInfo>'),
        "Hungaricana": _text('{"width": ', w, ', "height": ', h, "}"),
        "WMTS": _text('<Capabilities xmlns:ows="http://www.opengis.net/ows/1.1"><Contents><Layer><ows:BoundingBox crs="urn:ogc:def:crs:EPSG::3857"><ows:LowerCorner>500 ', 1000000 - 503 - 10 * h, "</ows:LowerCorner><ows:UpperCorner>", 503 + 10 * w, ' 999500</ows:UpperCorner></ows:BoundingBox><ResourceURL template="t"/></Layer><TileMatrixSet><ows:Identifier>web</ows:Identifier><ows:SupportedCRS>urn:ogc:def:crs:EPSG::3857</ows:SupportedCRS>' + matrices + "</TileMatrixSet></Contents></Capabilities>"),
    }
    name, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (format_, text) in enumerate(bodies.items()):
        name, body = F.when(k == i, format_).otherwise(name), F.when(k == i, text).otherwise(body)
    docs = pages.select(n.alias("request_id"), _text(SITE, "imagesize/m", n, ".ecw").alias("url"), name.alias("format"), body.alias("body"))
    out = parse(docs, list(bodies))
    detail = {
        "TopViewer": F.col("url_template"), "krpano": F.col("url_template"), "Zoomify PFF": F.concat_ws(",", F.element_at("offsets", -1), F.col("index_end")), "LizardTech": F.concat_ws(",", "catalog", "item"), "VLS": F.col("path"),
        "Micrio": F.element_at("tile_map", F.lit("0,0")), "Arts & Culture": F.col("max_zoom_level").cast("string"), "Hungaricana": F.col("path"), "WMTS": F.concat_ws(",", "tile_min_col", "tile_max_col"),
    }
    told = F.lit(None).cast("string")
    for format_, c in detail.items():
        told = F.when(F.col("format") == format_, c).otherwise(told)
    return out.select(F.col("request_id").alias("page_id"), "format", "width", "height", F.col("tile_size").cast("int"), told.alias("detail"), F.col("error").isNotNull().alias("failed"))


#: Of each kind of page: format, URL, page, further document (URL, body), and the metadata URL, with {} for the page's number.
KINDS = (
    ("IIPImage", "q/{}", "<img src='view?FIF=/r/{}.tif&amp;cvt=jpeg'>", None, "{s}q/view?FIF=/r/{}.tif&cvt=jpeg"),
    ("Zoomify PFF", "one?file=/{}.pff&requestType=2&begin=4&end=9", None, None, "{s}one?file=/{}.pff"),
    ("Zoomify PFF", "page/{}", "zoomifyServerIP=z.example&zoomifyTileHandlerPath=/srv&zoomifyImagePath=/{}.pff'", None, "http://z.example/srv?file=/{}.pff"),
    ("TopViewer", "thumb/{}", "<img src='https://images.memorix.nl/abc/thumb/100x100/d-{}.jpg'>", None, "http://images.memorix.nl/abc/topviewjson/memorix/d-{}"),
    ("TopViewer", "server/{}", '{{"server": "https:\\/\\/tv.example\\/{}"}}', None, "https://tv.example/{}"),
    ("krpano", "pano/{}", 'embedpano({{swf: "a.swf", xml: "one{}.xml"}})', None, "{s}pano/one{}.xml"),
    ("FSI", "fsi/{}", "src='/fsi/server?type=image&source=plates/{}&width=9'", None, "{s}fsi/server?type=info&source=plates/{}"),
    ("Micrio", "set/{}#/K-2,30", 'dataSourcePath: "/api/{}", dataSourceQuery: "?offset=0&n=9"', ("{s}api/{}?offset=30&n=9", '{{"setItems": [{{"ObjectNumber": "K-1", "TilingUrl": "/t/1"}}, {{"ObjectNumber": "K-2", "TilingUrl": "/t/{}"}}]}}'), "{s}t/{}"),
    ("Arts & Culture", "ac/{}", '["a"],"//lh.example/abc-{}","tok"', None, "https://lh.example/abc-{}=g"),
    ("Hungaricana", "hu/{}?pg=1", "layer_url: '/imagesize/' images: [\"k.ecw\",\"l{}.ecw\"]", None, "{s}imagesize/l{}.ecw"),
    ("Mnesys", "roll/{}", 'flashVars = "playlist=p{}.xml&cur_item=1"', ("{s}roll/p{}.xml", '<playlist basepath="/img/" host="https://roll.example"><a>one.jpg</a><a>leaf.{}.jpg</a></playlist>'), "https://roll.example/img/leaf_{}.jpg_/p.xml"),
    ("LizardTech", "lizardtech/iserv/calcrgn?item={}", None, None, "{s}lizardtech/iserv/calcrgn?item={}"),
    ("WMTS", "wmts?{}", None, None, "{s}wmts?{}"),
    ("pnav", "entity/OBJECT/{}", None, None, "{s}entity/OBJECT/{}"),
    ("Seadragon", "old/{}_files/9/0_1.jpg", None, ("{s}old/{}.xml", "<Image/>"), "{s}old/{}.xml"),
    ("Micrio", "own/{}", '<i data-role="micrio" data-id="{}" data-base-path="https://m.example/t?id=">', None, "https://m.example/t?id={}"),
    ("IIIF", "look/{}?manifest=http%3A%2F%2Fh.example.org%2Fm{}.json", None, ("{s}m{}.json", '{{"sequences": [{{"canvases": [{{"images": [{{"resource": {{"service": [{{"id": "none"}}, {{"@id": "http://i.example/{}/", "profile": "http://iiif.io/api/image/2/level0.json"}}]}}}}]}}]}}]}}'), "http://i.example/{}/info.json"),
)


def _parts(text: str) -> list:
    """A text of KINDS with the page's number in it, as parts."""
    pieces = text.replace("{s}", SITE).replace("{{", "\0").replace("}}", "\1").split("{}")
    plain = [p.replace("\0", "{").replace("\1", "}") for p in pieces]
    return [x for i, p in enumerate(plain) for x in ([None] if i else []) + [p]]


def _sql(text: str) -> str:
    return " || ".join("CAST(page_id AS VARCHAR)" if p is None else "'" + p.replace("'", "''") + "'" for p in _parts(text))


@query(f"SELECT page_id, CASE page_id % {len(KINDS)} {' '.join(f'WHEN {i} THEN {_sql(kind[4])}' for i, kind in enumerate(KINDS))} END AS meta_url, CASE WHEN page_id % {len(KINDS)} = 8 THEN 'tok' END AS token FROM pages")
def discover_more_urls(spark, sf_dir):
    """Pages of the formats that discover_urls() leaves: what a page says, what its URL says, and what a second document says."""
    from tessera.operators.discover import discover

    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    n, k = F.col("id"), F.col("id") % len(KINDS)
    filled = lambda text: _text(*(n if p is None else p for p in _parts(text)))
    name, url, held = F.lit(None).cast("string"), F.lit(None).cast("string"), []
    for i, (format_, at, page, more, _) in enumerate(KINDS):
        name, url = F.when(k == i, format_).otherwise(name), F.when(k == i, filled("{s}" + at)).otherwise(url)
        if page:
            held.append((k == i, filled("{s}" + at), filled(page)))
        if more:
            held.append((k == i, filled(more[0]), filled(more[1])))
    found = discover(pages.select(n.alias("request_id"), url.alias("url"), name.alias("format")), _documents(pages, held))
    return found.select(F.col("request_id").alias("page_id"), "meta_url", "token")


@query("""WITH i AS (SELECT page_id AS image_id, page_id * 50 AS x0, (page_id * 104729) % 4000 AS y0, CASE WHEN page_id % 100 = 0 THEN 20000 ELSE 64 + (page_id * 7919) % 1500 END AS w, 64 + (page_id * 37) % 900 AS h FROM pages),
  b AS (SELECT page_id AS box_id, page_id * 50 + (page_id * 31337) % 1000 AS x0, (page_id * 7) % 4000 AS y0, CASE WHEN page_id % 64 = 0 THEN 5000 ELSE 10 + (page_id * 13) % 700 END AS w, 10 + (page_id * 17) % 500 AS h FROM pages),
  o AS (SELECT box_id, image_id, greatest(i.x0, b.x0) - i.x0 AS ax, greatest(i.y0, b.y0) - i.y0 AS ay, least(i.x0 + i.w, b.x0 + b.w) - i.x0 AS ex, least(i.y0 + i.h, b.y0 + b.h) - i.y0 AS ey FROM i JOIN b ON i.x0 < b.x0 + b.w AND b.x0 < i.x0 + i.w AND i.y0 < b.y0 + b.h AND b.y0 < i.y0 + i.h)
  SELECT box_id, image_id, CAST(ax // 256 AS INTEGER) AS first_x, CAST((ex - 1) // 256 AS INTEGER) AS last_x, CAST(ay // 256 AS INTEGER) AS first_y, CAST((ey - 1) // 256 AS INTEGER) AS last_y, CAST(((ex - 1) // 256 - ax // 256 + 1) * ((ey - 1) // 256 - ay // 256 + 1) AS BIGINT) AS tiles FROM o""")
def boxes_on_images(spark, sf_dir):
    """The tiles that many boxes need of many images, joined on cells of a quadtree."""
    from tessera.operators.boxes import tiles_in_boxes

    k = F.col("page_id")
    pages = read(spark, sf_dir, "pages").select("page_id")
    placed = lambda x, y, w, h: {"x0": x, "y0": y, "x1": x + w, "y1": y + h}
    wide, high = F.when(k % 100 == 0, 20000).otherwise(64 + (k * 7919) % 1500), 64 + (k * 37) % 900
    images = pages.select(k.alias("image_id"), *(c.alias(n) for n, c in placed(k * 50, (k * 104729) % 4000, wide, high).items()), wide.alias("width"), high.alias("height"), F.lit(256).alias("tile_size"))
    boxes = pages.select(k.alias("box_id"), *(c.alias(n) for n, c in placed(k * 50 + (k * 31337) % 1000, (k * 7) % 4000, F.when(k % 64 == 0, 5000).otherwise(10 + (k * 13) % 700), 10 + (k * 17) % 500).items()))
    ends = [f(c).alias(f"{name}_{c}") for c in ("x", "y") for f, name in ((F.min, "first"), (F.max, "last"))]
    return tiles_in_boxes(boxes, images).groupBy("box_id", "image_id").agg(*ends, F.count(F.lit(1)).alias("tiles"))


@query(f"""WITH RECURSIVE p AS (SELECT page_id AS id, (SELECT count(*) FROM pages) AS total FROM pages),
  d AS (SELECT id, CASE WHEN id % 4 > 0 THEN (id * 3 + 1) % total END AS next FROM p WHERE id % 11 <> 7),
  c AS (SELECT id AS root, id, next, 0 AS hops FROM d UNION ALL SELECT c.root, d.id, d.next, hops + 1 FROM c JOIN d ON d.id = c.next WHERE hops < 3),
  e AS (SELECT root, arg_max(id, hops) AS id, arg_max(coalesce(next, -1), hops) AS next, max(hops) AS hops FROM c GROUP BY root)
  SELECT root AS page_id, '{SITE}d/' || id AS final_url, CAST(hops AS INTEGER) AS hops, CASE WHEN next >= 0 AND next % 11 <> 7 OR next < 0 OR hops = 3 THEN 'body ' || id END AS body, CASE WHEN hops = 3 AND next >= 0 THEN '{SITE}d/' || next END AS disabled_location, CASE WHEN hops < 3 AND next >= 0 THEN '{SITE}d/' || next END AS needs_url FROM e""")
def redirect_chains(spark, sf_dir):
    """Documents that lead on to others: three redirects are followed, some go round, some lead out of the crawl."""
    from tessera.sources.archives import followed

    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    total, k = pages.count(), F.col("id")
    docs = pages.filter(k % 11 != 7).select(_text(SITE, "d/", k).alias("url"), F.when(k % 4 > 0, _text((k * 3 + 1) % total)).alias("location"), _text("body ", k).alias("body"))
    return followed(docs).select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), "final_url", "hops", "body", "disabled_location", "needs_url")
