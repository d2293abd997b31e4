"""Formats of one's own beside the built-in ones, formats chosen by hand, and the grid as a function of SQL."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import detect, formats, grid, tileurl
from tessera.operators.discover import Discovery
from tessera.operators.formats import BUILT_IN, FormatSpec
from tessera.plans import crawl

SITE = "http://own.example"


def own_parse(docs):
    w, h = (F.regexp_extract("body", p, 1).try_cast("bigint") for p in (r"(\d+) by", r"by (\d+)"))
    out = docs.select("request_id", "url", F.lit("Own").alias("format"), F.col("url").alias("origin"), w.alias("width"), h.alias("height"), F.lit(100).alias("tile_size"))
    return out.withColumn("error", F.when(F.col("width").isNull(), "No size."))


OWN = FormatSpec("Own", (r"own\.example/picture/",), (r"<own-viewer",), lambda: Discovery(direct=F.when(F.col("url").endswith(".size"), F.col("url")), found=F.when(F.col("page").isNotNull(), F.concat(F.col("url"), F.lit(".size")))), own_parse, lambda: F.concat(F.lit("t/"), F.col("x").cast("string"), F.lit("-"), F.col("y").cast("string")))
HELD = [(f"{SITE}/picture/1", "x"), (f"{SITE}/picture/1.size", "250 by 90"), (f"{SITE}/page", "<own-viewer>"), (f"{SITE}/page.size", "30 by 30"), (f"{SITE}/bad.size", "nothing"), (f"{SITE}/d.dzi", '<Image TileSize="50" Overlap="0" Format="png"><Size Width="60" Height="40"/></Image>'), (f"{SITE}/chosen", "krpano"), (f"{SITE}/chosen.size", "10 by 20")]
ASKED = [(1, f"{SITE}/picture/1", None), (2, f"{SITE}/page", None), (3, f"{SITE}/bad.size", "Own"), (4, f"{SITE}/d.dzi", None), (5, f"{SITE}/chosen", "Own"), (6, "ftp://own.example/x", "Own"), (7, f"{SITE}/page", "None such")]


def test_a_format_of_ones_own_from_page_to_tile(spark):
    registry = BUILT_IN.only("Seadragon").add(OWN)
    requests = spark.createDataFrame(ASKED, "request_id long, url string, format string")
    out = crawl.describe(requests, spark.createDataFrame(HELD, "url string, body string"), registry)
    rows = {r.request_id: r for r in out.collect()}
    assert {k: (r.format, r.failed_at) for k, r in rows.items()} == {1: ("Own", None), 2: ("Own", None), 3: ("Own", "parse"), 4: ("Seadragon", None), 5: ("Own", None), 6: (None, "detect"), 7: ("None such", "discover")}
    urls = {(r.request_id, r.x, r.y): r.url for r in crawl.tiles(out, registry).collect()}
    assert urls[1, 2, 0] == f"{SITE}/picture/t/2-0" and len([k for k in urls if k[0] == 1]) == 3 and urls[5, 0, 0] == f"{SITE}/t/0-0" and urls[4, 1, 0].endswith("d_files/6/1_0.png")


def test_registries_are_values():
    more = BUILT_IN.add(OWN, before="Zoomify")
    assert more.names[0] == "Own" and "Own" not in BUILT_IN.names and len(BUILT_IN.names) == 18
    other = FormatSpec("IIPImage", (r"never",))
    replaced = more.add(other)
    assert replaced["IIPImage"] is other and replaced.names == more.names and more["IIPImage"].parse
    assert more.add(OWN, before="pnav").names[-2:] == ["Own", "pnav"]
    with pytest.raises(ValueError):
        formats.Formats((OWN, OWN))


def test_priority_decides_between_formats(spark):
    page = spark.createDataFrame([("<own-viewer> krpano",)], "b string")
    for registry, want in ((BUILT_IN.add(OWN), "krpano"), (BUILT_IN.add(OWN, before="krpano"), "Own"), (BUILT_IN.only("IIIF"), None)):
        assert page.select(detect.by_content(F.col("b"), registry.rules).alias("f")).first().f == want


def test_keyed_formats_need_their_key():
    assert "Hungaricana" not in BUILT_IN.builders() and "Hungaricana" in BUILT_IN.builders({"Hungaricana": "0123456789abcdef"})
    assert set(BUILT_IN.builders()) == set(tileurl.BUILDERS)


def test_the_grid_in_sql(spark):
    formats.register_sql(spark)
    rows = [(1, 500, 330, 200, 0), (2, 500, 330, 200, 3), (3, 0, 10, 200, 0), (4, None, 10, 200, 0), (5, 200, 200, 200, 1), (6, 201, 1, 200, 1)]
    images = spark.createDataFrame(rows, "image_id long, width long, height long, tile_size int, overlap int")
    got = spark.sql("SELECT image_id, t.* FROM (SELECT image_id, tile_grid(width, height, tile_size, overlap) AS tiles FROM {images}), LATERAL inline(tiles) AS t", images=images)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Exchange" not in plan
    want = grid.plan_tiles(images).select("image_id", "x", "y", "tile_index", "px", "py")
    assert sorted(got.drop("tile_w", "tile_h").collect()) == sorted(want.collect())
    assert [(r.tile_w, r.tile_h) for r in got.filter("image_id = 2").orderBy("tile_index").collect()] == [(203, 203), (206, 203), (103, 203), (203, 133), (206, 133), (103, 133)]
