"""Templates and origins are split once an image: what they give must not change, and a tile's expression is compiled."""

from pyspark.sql import functions as F

from tessera.operators import tileurl
from tessera.plans import queries as q


def krpano(spark, template, level=3):
    tile = spark.range(1).select(F.lit(9).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("base_index"), F.lit(level).cast("int").alias("level_index"), F.lit(template).alias("url_template"))
    return tileurl.with_template_parts(tile, "krpano").select(tileurl.krpano(F.col("template_parts")).alias("a"), tileurl.krpano().alias("b")).first()


def test_templates_of_any_number_of_places(spark):
    want = {
        "l%l/%0v/p_%s_%00h%%.jpg": "l3/01/p_f_010%.jpg", "%h": "10", "none": "none", "%h%v%u%y%x%r": "101101101", "%000l|%0%|%f": "0003|0%|1", "%q/%h": None,
    }
    for template, url in want.items():
        assert tuple(krpano(spark, template)) == (url, url), template
    assert tuple(krpano(spark, "%h/%l", None)) == (None, None)
    assert tuple(krpano(spark, "%h", None)) == ("10", "10")


def test_generic_pads_with_any_sign(spark):
    for template, url in {"{{X:04}}-{{y}}": "0007-12", "{{x:*3}}{{Y}}{{x}}{{y}}{{X}}": "**7127127", "{{y:01}}": "12", "": ""}.items():
        row = spark.range(1).select(F.lit(7).alias("x"), F.lit(12).alias("y"), F.lit(template).alias("origin"))
        assert row.select(tileurl.generic()).first()[0] == url


def test_places_that_tiles_share_are_split_before_the_tiles_are_made(spark):
    """Work per tile that is the same for all tiles of an image made these queries ten and five times as slow as the grid."""
    for name, part in (("krpano_template", "template_parts"), ("generic_template", "template_parts"), ("vls_url", "origin_parts"), ("mnesys_url", "origin_parts")):
        plan = q.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.find(f"AS {part}") > plan.rindex("Generate explode"), name
        assert "regexp_extract_all" not in plan[: plan.index("Generate explode")], name


def test_known_bases_resolve_alike(spark):
    rows = [(p, b) for p in ("a/b.jpg", "/a.jpg", "//h/x", "http://z/1", "../c", "../../c", "..//c", "../../../../c", "./d", "") for b in ("http://h/p/q/r.html", "http://h", "x/y", "h", "")]
    df = spark.createDataFrame(rows, "path string, origin string")
    df = tileurl.with_origin_parts(df)
    from tessera.functions.text import resolve_relative

    got = df.select(resolve_relative(F.col("path"), F.col("origin"), (F.col("origin_parts.root"), F.col("origin_parts.folder"))).alias("a"), resolve_relative(F.col("path"), F.col("origin")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    of = {(p, b): r.a for (p, b), r in zip(rows, got)}
    assert of["../c", "http://h/p/q/r.html"] == "http://h/p/c" and of["..//c", "http://h/p/q/r.html"] == "http://h/c" and of["a/b.jpg", "h"] == "h/a/b.jpg" and of["/a.jpg", "http://h"] == "http:/a.jpg"


def test_a_zoom_of_nothing_counts_as_unset(spark):
    """At 257 pixels the rule for unlike tile counts gives 0, which viewers take as unset: the level is 1."""
    from tessera.operators import grid, parse

    row = spark.range(1).select(F.lit(257).alias("width"), F.lit(64).alias("height"), F.lit(256).alias("tile_size"), F.lit(2).alias("num_tiles"))
    row = row.withColumn("max_zoom_level", parse.zoomify_zoom())
    assert row.first().max_zoom_level == 0 and grid.with_defaults(row).first().zoom == 1
