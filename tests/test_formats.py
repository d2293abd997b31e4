"""A metadata document of each format, its descriptor, and the URLs of its tiles."""

import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tessera.operators import grid, parse, tileurl
from tessera.operators.detect import by_content, by_url, detect
from tessera.operators.discover import discover, manifest_service

A = "https://atlas.example"
DOC = "request_id long, url string, format string, body string"
SCENE = '<krpano><image tilesize="160" baseindex="0"><level tiledimagewidth="320" tiledimageheight="160"><front url="s/%l/%0v-%0h.png"/></level><level tiledimagewidth="640" tiledimageheight="320"><front url="s/%l/%0v-%0h.png"/></level></image></krpano>'
PFF = 'reply_data=<PFF WIDTH="300" HEIGHT="200" TILESIZE="100" NUMTILES="6" HEADERSIZE="20"/>\nreply_data=5000,' + "".join(f"{n:9d}" for n in (40, 95, 130, 200, 260, 333))
# Tiles of 128 pixels are 1000 m wide in the finer matrix, 4000 m in the other; the layer reaches from 2500 to 6500 m
# eastwards and from 8500 down to 5500 m, the matrices begin at (0, 10000).
MATRIX = "<TileMatrix><ows:Identifier>{0}</ows:Identifier><ScaleDenominator>{1}</ScaleDenominator><TopLeftCorner>0 10000</TopLeftCorner><TileWidth>128</TileWidth><TileHeight>128</TileHeight></TileMatrix>"
WMTS = (
    '<Capabilities xmlns:ows="http://www.opengis.net/ows/1.1"><Contents><Layer><ows:BoundingBox crs="urn:ogc:def:crs:EPSG::3857"><ows:LowerCorner>2500 5500</ows:LowerCorner><ows:UpperCorner>6500 8500</ows:UpperCorner></ows:BoundingBox>'
    f'<Style><ows:Identifier>dim</ows:Identifier></Style><ResourceURL template="{A}/w/{{Style}}/{{TileMatrixSet}}/{{TileMatrix}}/{{TileRow}}-{{TileCol}}.png"/></Layer><TileMatrixSet><ows:Identifier>web</ows:Identifier><ows:SupportedCRS>urn:ogc:def:crs:EPSG::3857</ows:SupportedCRS>'
    + MATRIX.format("far", 4000 / (128 * 0.00028)) + MATRIX.format("near", 1000 / (128 * 0.00028)) + "</TileMatrixSet></Contents></Capabilities>"
)
CASES = [
    ("Zoomify", f"{A}/leaf/ImageProperties.xml", '<IMAGE_PROPERTIES WIDTH="700" HEIGHT="500" NUMTILES="17" NUMIMAGES="1" VERSION="1.8" TILESIZE="200"/>', 12, f"{A}/leaf/TileGroup0/2-3-2.jpg"),
    ("Seadragon", f"{A}/deep/leaf.dzi", '<Image xmlns="http://schemas.microsoft.com/deepzoom/2008" Format="png" Overlap="2" TileSize="300"><Size Height="400" Width="900"/></Image>', 6, f"{A}/deep/leaf_files/10/2_1.png"),
    ("IIIF", f"{A}/iiif/7/info.json", '{"@id": "%s/iiif/7", "width": 1000, "height": 450, "tiles": [{"width": 400, "scaleFactors": [1, 2, 4]}], "qualities": ["bitonal", "native"], "formats": ["tif", "png"]}' % A, 6, f"{A}/iiif/7/800,400,200,50/200,50/0/native.png"),
    ("IIPImage", f"{A}/fcgi?FIF=/scans/b.tif", "Max-size:1000 600\nTile-size:250 250\nResolution-number:3\n", 12, f"{A}/fcgi?FIF=/scans/b.tif&JTL=2,11"),
    ("krpano", f"{A}/tour/scene.xml", SCENE, 8, f"{A}/tour/s/1/01-03.png"),
    ("Zoomify PFF", f"{A}/one?file=/q.pff", PFF, 6, f"{A}/one?file=/q.pff&requestType=0&head=20&begin=5260&end=5333"),
    ("XLimage", f"{A}/xl/0004.imgi?cmd=info", "<i><width>450</width><height>310</height><tileside>150</tileside></i>", 9, f"{A}/xl/0004.imgi?cmd=tile&x=2&y=2&z=1"),
    ("TopViewer", f"{A}/views/9.json", '{"config": {"tileurl_v2": "/tv/{file}/{tile}.{extension}"}, "topviews": [{"filepath": "f9", "width": 480, "height": 300, "tileWidth": 240, "layers": [{"no": 1, "width": 480, "starttile": 20, "cols": 2}, {"no": 0, "width": 240, "starttile": 5, "cols": 1}]}]}', 4, f"{A}/tv/f9/23.jpg"),
    ("FSI", f"{A}/fsi/server?type=info&source=plate", '<image><width value="640"/><height value="1024"/></image>', 4, f"{A}/fsi/server?type=image&source=plate&width=128&height=512&rect=0.8,0.5,0.2,0.5"),
    # A square of 2048 around 1280 x 640: margins of 0.3 and 1.1; the last tile's centre is at 1280 / 1280 and 768 / 640.
    ("LizardTech", f"{A}/lizardtech/iserv/calcrgn?cat=x&item=y", '<ImageServer path="/lizardtech/iserv/"><Request><Parameter name="item">a/b.sid</Parameter></Request><Catalog name="Old Maps"><Image width="1280" height="640" name="b.sid" parent="a"/></Catalog></ImageServer>', 6, f"{A}/lizardtech/iserv/getimage?cat=Old%20Maps&item=a%2Fb.sid&wid=512&hei=512&oif=jpeg&lev=0&cp=0.7,{1.2 - 1.1!r}"),
    ("VLS", f"{A}/vls/zoom/33", '<html xmlns:vls="urn:v"><div id="map" vls:height="1100" vls:width="1500" vls:ot_id="doc33"/><var id="zoomTileSize" value="400"/></html>', 4, f"{A}/image/tiler/square/doc33/0/1/1"),
    ("Micrio", f"{A}/m/api/getTilesInfo?object_id=8", '{"levels": [{"width": 300, "height": 200, "tiles": []}, {"width": 700, "height": 500, "tiles": [{"x": 0, "y": 0, "url": "%s/a.jpg"}, {"x": 1, "y": 0, "url": "%s/b.jpg"}]}]}' % (A, A), 2, f"{A}/b.jpg"),
    ("Mnesys", f"{A}/roll/p.xml", '<p><layer z="4" w="300" h="200" t="100"/><layer z="7" w="600" h="400" t="100"/><layer z="1" w="150" h="100" t="100"/></p>', 24, f"{A}/roll/1_23.jpg"),
    ("WMTS", f"{A}/wmts/WMTSCapabilities.xml", WMTS, 20, f"{A}/w/dim/web/near/4-6.png"),
]
BY_CONTENT_ONLY = ("TopViewer", "krpano", "Zoomify PFF", "FSI")


def planned(spark, name, url, body):
    return tileurl.with_tile_urls(grid.plan_tiles(parse.parse(spark.createDataFrame([(1, url, name, body)], DOC), [name])), [name])


@pytest.mark.parametrize("name,url,body,count,last", CASES, ids=[c[0] for c in CASES])
def test_document_to_tiles(spark, name, url, body, count, last):
    images = parse.parse(spark.createDataFrame([(1, url, name, body)], DOC), [name])
    assert images.select("error").first().error is None
    tiles = planned(spark, name, url, body).orderBy("tile_index").collect()
    assert len(tiles) == count
    assert tiles[-1].url == last
    assert name in BY_CONTENT_ONLY or spark.range(1).select(by_url(F.lit(url)).alias("f")).first().f == name


@pytest.mark.parametrize("name,body", [(c[0], "garbage <") for c in CASES if c[0] not in ("Seadragon", "LizardTech", "VLS", "Mnesys", "WMTS", "Zoomify", "XLimage")])
def test_unreadable_documents_are_error_rows(spark, name, body):
    rows = parse.parse(spark.createDataFrame([(1, f"{A}/x/info", name, body), (2, f"{A}/y/info", name, None)], DOC), [name]).collect()
    assert len(rows) == 2 and all(r.error for r in rows)


def test_rows_of_other_formats_stay_as_errors(spark):
    rows = parse.parse(spark.createDataFrame([(1, "u", "Generic", "b"), (2, "u", None, "b"), (3, "u", "none such", None)], DOC), ["IIIF"]).collect()
    assert sorted(r.request_id for r in rows) == [1, 2, 3] and all(r.error for r in rows)


def test_pff_first_tile_begins_after_the_index(spark):
    # 0x424 + 20 of the header + 8 for each of 6 tiles.
    assert "begin=1128&end=5040" in planned(spark, *[c for c in CASES if c[0] == "Zoomify PFF"][0][:3]).filter("tile_index = 0").first().url


def test_zoomify_counts_of_full_resolution_only(spark):
    body = '<IMAGE_PROPERTIES WIDTH="3000" HEIGHT="1300" NUMTILES="390" TILESIZE="100"/>'
    tiles = [t.url for t in planned(spark, "Zoomify", f"{A}/leaf/ImageProperties.xml", body).orderBy("tile_index").collect()]
    assert len(tiles) == 390 and all("/TileGroup0/" in t for t in tiles) and tiles[-1].endswith("/5-29-12.jpg")


def test_zoomify_groups_count_the_levels_below(spark):
    # 390, 105, 28, 8, 2 and 1 tiles: those of full size are numbers 144 to 533, so groups 0, 1 and 2.
    body = '<IMAGE_PROPERTIES WIDTH="3000" HEIGHT="1300" NUMTILES="534" TILESIZE="100"/>'
    tiles = [t.url for t in planned(spark, "Zoomify", f"{A}/leaf/ImageProperties.xml", body).orderBy("tile_index").collect()]
    groups = [int(t.split("TileGroup")[1].split("/")[0]) for t in tiles]
    assert groups == [(144 + k) // 256 for k in range(390)]


def test_deep_zoom_overlap_places(spark):
    images = spark.createDataFrame([(1, 500, 500, 250, 3)], "image_id int, width int, height int, tile_size int, overlap int")
    assert [(r.px, r.py) for r in grid.plan_tiles(images).orderBy("tile_index").collect()] == [(0, 0), (247, 0), (0, 247), (247, 247)]


def test_iiif_clips_at_the_edge(spark):
    images = spark.createDataFrame([("IIIF", "http://h/i", 500, 330, 200, "default", "jpg")], "format string, origin string, width int, height int, tile_size int, quality string, image_format string")
    urls = {(r.x, r.y): r.url for r in tileurl.with_tile_urls(grid.plan_tiles(images), ["IIIF"]).collect()}
    assert urls[0, 0].endswith("/0,0,200,200/200,200/0/default.jpg") and urls[2, 1].endswith("/400,200,100,130/100,130/0/default.jpg")


@pytest.mark.parametrize("own,url,origin", [
    ("http://192.168.7.7/k", f"{A}/p/info.json", f"{A}/p"),
    ("http://atlas.example:80/k", f"{A}/k/info.json", f"{A}/k"),
    ("http://atlas.example/k", f"{A}/k/info.json", f"{A}/k"),
    ("https, https://cdn.example/k", f"{A}/k/info.json", "https://cdn.example/k"),
    ("http://localhost/k", f"{A}/q/info.json?v=3", f"{A}/q"),
    ("", f"{A}/r/info.json", f"{A}/r"),
])
def test_iiif_origins(spark, own, url, origin):
    body = '{"@id": "%s", "width": 90, "height": 70}' % own
    assert parse.parse(spark.createDataFrame([(1, url, "IIIF", body)], DOC), ["IIIF"]).first().origin == origin


def test_iiif_version_3_and_defaults(spark):
    body = '{"id": "%s/v3/5", "width": 640, "height": 480, "extraFormats": ["webp"]}' % A
    r = parse.parse(spark.createDataFrame([(1, f"{A}/v3/5/info.json", "IIIF", body)], DOC), ["IIIF"]).first()
    assert (r.origin, r.quality, r.image_format, r.tile_size) == (f"{A}/v3/5", "default", "jpg", 512)


def test_iiif_probe_replaces_the_tile_size(spark):
    docs = spark.createDataFrame([(1, f"{A}/v2/5/info.json", "IIIF", '{"@id": "%s/v2/5", "width": 640, "height": 480}' % A)], DOC)
    first = f"{A}/v2/5/0,0,512,480/512,480/0/default.jpg"
    for ok, size in ((True, 300), (False, 512)):
        probes = spark.createDataFrame([(first, ok, 300, 281)], "url string, ok boolean, width int, height int")
        assert parse.iiif(docs, probes).first().tile_size == size


def test_page_geometry(spark):
    tiles = planned(spark, "Seadragon", "https://museo.example/obra/9", '<img data-height="700" data-width="1000" class="img_cache" data-pyr="/pir/9">')
    assert tiles.count() == 12 and tiles.filter("tile_index = 0").first().url == "https://museo.example/pir/9/10/0_0.jpg"


def test_lizardtech_small_image_has_no_tile_url(spark):
    body = '<ImageServer><Catalog name="c"/><Image width="200" height="180" name="n"/></ImageServer>'
    assert [r.url for r in planned(spark, "LizardTech", f"{A}/lizardtech/iserv/calcrgn?x", body).collect()] == [None]


def test_arts_culture_takes_the_last_level_that_fits(spark):
    # 2 x 2 tiles of 100 without 30 and 10 pixels; the other level is beyond the canvas.
    body = '<TileInfo tile_width="100" tile_height="100"><pyramid_level num_tiles_x="1" num_tiles_y="1" empty_pels_x="0" empty_pels_y="0"/><pyramid_level num_tiles_x="2" num_tiles_y="2" empty_pels_x="30" empty_pels_y="10"/><pyramid_level num_tiles_x="900" num_tiles_y="900" empty_pels_x="0" empty_pels_y="0"/></TileInfo>'
    r = parse.parse(spark.createDataFrame([(1, f"{A}/g=g", "Arts & Culture", body)], DOC), ["Arts & Culture"]).first()
    assert (r.error, r.width, r.height, r.tile_size, r.num_tiles, r.max_zoom_level) == (None, 170, 190, 100, 4, 1)


def test_hungaricana_size_document(spark):
    r = parse.parse(spark.createDataFrame([(1, f"{A}/imagesize/maps/b.ecw", "Hungaricana", '{"width": 1300, "height": 600}')], DOC), ["Hungaricana"]).first()
    assert (r.error, r.path, r.origin, r.width, r.height) == (None, "maps/b.ecw", f"{A}/image/maps/b.ecw/", 1300, 600)


def test_keyed_formats_with_throwaway_keys(spark):
    rows = spark.createDataFrame([("a/b", 0, 4, 5, "http://h/image/a/")], "path string, zoom int, x int, y int, origin string")
    url = rows.select(tileurl.hungaricana("0123456789abcdef").alias("u")).first().u
    assert url.startswith("http://h/image/a/") and len(url) == len("http://h/image/a/") + 32
    signed = rows.select(tileurl.signed_path(b"k")(F.lit("p"), F.lit("tok"), "x", "y", "zoom").alias("u")).first().u
    mac = base64.b64encode(hmac.new(b"k", b"p=x4-y5-z0-ttok", hashlib.sha1).digest()).decode()
    assert signed == "p=x4-y5-z0-t" + mac.rstrip("=").replace("+", "_").replace("/", "_")


def test_coded_tiles(spark):
    key, iv = (F.lit(bytes([k] * 16)).cast("binary") for k in (3, 9))
    number = lambda n: F.lit(n.to_bytes(4, "little")).cast("binary")
    coded = F.expr("substring(aes_encrypt(cast('the middle of a tile' as binary), unhex(repeat('03', 16)), 'CBC', 'PKCS', unhex(repeat('09', 16))), 17)")
    raw = F.concat(F.unhex(F.lit("0A0A0A0A")), F.lit(b"head").cast("binary"), number(32), coded, F.lit(b"tail").cast("binary"), number(4))
    row = spark.range(1).select(tileurl.decrypted_tile(raw, key, iv).alias("tile"), tileurl.decrypted_tile(F.lit(b"plain tile").cast("binary"), key, iv).alias("plain")).first()
    assert bytes(row.tile) == b"headthe middle of a tiletail" and bytes(row.plain) == b"plain tile"


def test_generic_counts_and_template(spark):
    probes = spark.createDataFrame([(1, "http://h/{{Y:_2}}/{{x}}.png", x, y, x < 3 and y < 2, 300, 200) for x in range(5) for y in range(5)], "request_id int, url string, x int, y int, ok boolean, width int, height int")
    tiles = tileurl.with_tile_urls(grid.plan_tiles(parse.generic(probes)), ["Generic"]).orderBy("tile_index").collect()
    assert [t.url for t in tiles] == [f"http://h/_{y}/{x}.png" for y in range(2) for x in range(3)]


def test_crops_of_one_image(spark):
    docs = spark.createDataFrame([(1, f"{A}/entity/OBJECT/5", '<meta property="og:image" content="%s/i/5?w=1000&h=1000">' % A, 700, 600, 512)], "request_id long, url string, page string, source_width int, source_height int, probe_width int")
    tiles = tileurl.with_tile_urls(grid.plan_tiles(parse.pnav(docs)), ["pnav"]).orderBy("tile_index").collect()
    assert [t.url for t in tiles] == [f"{A}/i/5?w={w}&h={h}&cl={x}&ct={y}&cw={cw}&ch={ch}" for x, y, cw, ch, w, h in ((0, 0, 512, 512, 2000, 2000), (512, 0, 188, 512, 2000, 2000), (0, 512, 512, 88, 2000, 2000), (512, 512, 188, 88, 188, 88))]


def test_detection_of_pages_frames_and_cycles(spark):
    requests = spark.createDataFrame([(11, f"{A}/start"), (12, f"{A}/round"), (13, "ftp://x"), (14, f"{A}/z?FIF=k&topview"), (15, f"{A}/absent")], "request_id long, url string")
    pages = spark.createDataFrame([(f"{A}/start", "<p><IFRAME width=9 src='inner?k=1&amp;l=2'>"), (f"{A}/inner?k=1&l=2", "var v = 'zoomifyImagePath=/scan/';"), (f"{A}/round", '<frame src="about">'), (f"{A}/about", '<frame src="round">')], "url string, body string")
    found = {r.request_id: r for r in detect(requests, pages).collect()}
    assert (found[11].format, found[11].found_url) == ("Zoomify", f"{A}/inner?k=1&l=2")
    assert found[12].format is None and found[12].error and found[13].error and found[15].error
    assert found[14].format == "IIPImage"


def test_detection_by_content(spark):
    rows = spark.createDataFrame([('Seadragon.embed(400, "plan.dzi")',), ('<p><micr-io lang="x" id="bZyXw">',), ("embedpano({})",), ("a plain page",)], "b string")
    assert [r.f for r in rows.select(by_content(F.col("b")).alias("f")).collect()] == ["Seadragon", "IIIF", "krpano", None]


#: Name of a case: (url, format, its page, further documents, metadata URL).
FOUND = {
    "path in the page": (f"{A}/zo", "Zoomify", '<base href="/lib/"><script>showImage(w, "scan/4"); zoomifyImagePath=scan/5&</script>', {}, f"{A}/lib/scan/4/ImageProperties.xml"),
    "tile": (f"{A}/n/TileGroup3/4-1-9.jpg", "Zoomify", None, {}, f"{A}/n/ImageProperties.xml"),
    "frame": (f"{A}/outer", "Zoomify", '<iframe src="inner">', {f"{A}/inner": "zoomifyImagePath=/n7'"}, f"{A}/n7/ImageProperties.xml"),
    "embedded": (f"{A}/em", "Seadragon", "Seadragon.embed('50%', '/deep/old.xml')", {}, f"{A}/deep/old.xml"),
    "deep zoom tile": (f"{A}/deep/k_files/9/0_0.jpg", "Seadragon", None, {}, f"{A}/deep/k.dzi"),
    "quoted": (f"{A}/iip", "IIPImage", "<img src='view?FIF=/r/1.tif&amp;cvt=jpeg'>", {}, f"{A}/view?FIF=/r/1.tif&cvt=jpeg"),
    "request": (f"{A}/one?file=/k.pff&requestType=2&begin=4&end=9", "Zoomify PFF", None, {}, f"{A}/one?file=/k.pff"),
    "handler": (f"{A}/pffpage", "Zoomify PFF", "zoomifyServerIP=z.example&zoomifyTileHandlerPath=/srv&zoomifyImagePath=/k.pff'", {}, "http://z.example/srv?file=/k.pff"),
    "viewer": ("https://u.kbr.be/multi/KBR-77Viewer/x", "XLimage", None, {}, "https://u.kbr.be/multi/KBR-77Viewer/xml.php?/multi/KBR-77/001.imgi?cmd=info"),
    "server": (f"{A}/tvpage", "TopViewer", r'{"server": "https:\/\/tv.example\/s"}', {}, "https://tv.example/s"),
    "thumb": (f"{A}/tvthumb", "TopViewer", "<img src='https://images.memorix.nl/abc/thumb/100x100/d-e.jpg'>", {}, "http://images.memorix.nl/abc/topviewjson/memorix/d-e"),
    "panorama": (f"{A}/pano/", "krpano", 'embedpano({swf: "a.swf", xml: "one.xml"})', {}, f"{A}/pano/one.xml"),
    "panorama without a page": (f"{A}/gone", "krpano", None, {}, None),
    "source": (f"{A}/fsipage", "FSI", "src='/fsi/server?type=image&source=plates/3&width=9'", {}, f"{A}/fsi/server?type=info&source=plates/3"),
    "manifest": (f"{A}/look?manifest=https%3A%2F%2Fatlas.example%2Fm2.json", "IIIF", None, {f"{A}/m2.json": '{"sequences": [{"canvases": [{"images": [{"resource": {"service": [{"id": "none"}, {"@id": "%s/img/m2/", "profile": "http://iiif.io/api/image/2/level0.json"}]}}]}]}]}' % A}, f"{A}/img/m2/info.json"),
    "manifest without a service": (f"{A}/look#?manifest={A}/bare.json", "IIIF", None, {f"{A}/bare.json": '{"items": [{"items": [{"items": [{"body": {"id": "one.png"}}]}]}]}'}, None),
    "record": ("https://library.example/digital/collection/posters/id/41", "IIIF", None, {"https://library.example/digital/api/singleitem/collection/posters/id/41": '{"iiifInfoUri": "/iiif/posters/41/info.json"}'}, "https://library.example/digital/iiif/posters/41/info.json"),
    "element": (f"{A}/element", "IIIF", "<micr-io id='bZyXw'>", {}, "https://i.micr.io/bZyXw/info.json"),
    "short id": (f"{A}/short", "IIIF", '{"shortId":"Pq7Rs"} philamuseum', {}, "https://i.micr.io/Pq7Rs/info.json"),
    "page number": (f"{A}/vls/pageview/52", "VLS", None, {}, f"{A}/vls/zoom/52"),
    "base path": (f"{A}/mipage", "Micrio", f'<i data-role="micrio" data-id="12" data-base-path="{A}/t?id=">', {}, f"{A}/t?id=12"),
    "data source": (f"{A}/set#/K-2,30", "Micrio", 'dataSourcePath: "/api/set", dataSourceQuery: "?offset=0&n=9"', {f"{A}/api/set?offset=30&n=9": '{"setItems": [{"ObjectNumber": "K-1", "TilingUrl": "/t/1"}, {"ObjectNumber": "K-2", "TilingUrl": "/t/2"}]}'}, f"{A}/t/2"),
    "signed image": (f"{A}/ac", "Arts & Culture", '["a"],"//lh.example/abc-1","tok"', {}, "https://lh.example/abc-1=g"),
    "layer": (f"{A}/hu?pg=1", "Hungaricana", "layerUrl = 0; layer_url: '/imagesize/' images: [\"k.ecw\",\"l.ecw\"]", {}, f"{A}/imagesize/l.ecw"),
    "playlist": (f"{A}/datas/playlists/k.xml", "Mnesys", '<playlist basepath="/img/" host="https://roll.example"><a>leaf.3.jpg</a></playlist>', {}, "https://roll.example/img/leaf_3.jpg_/p.xml"),
    "capabilities": (f"{A}/wmts?x", "WMTS", None, {}, f"{A}/wmts?x"),
}


def test_discovery(spark):
    names = list(FOUND)
    requests = spark.createDataFrame([(k, FOUND[n][0], FOUND[n][1]) for k, n in enumerate(names)], "request_id long, url string, format string")
    bodies = {url: page for url, _, page, _, _ in FOUND.values() if page is not None}
    for case in FOUND.values():
        bodies |= case[3]
    rows = {names[r.request_id]: r for r in discover(requests, spark.createDataFrame(list(bodies.items()), "url string, body string"), sorted({c[1] for c in FOUND.values()})).collect()}
    assert {n: r.meta_url for n, r in rows.items()} == {n: FOUND[n][4] for n in names}
    assert rows["panorama without a page"].needs_url == f"{A}/gone" and rows["manifest without a service"].error


def test_manifest_version_3(spark):
    body = '{"items": [{"items": [{"items": [{"body": {"service": [{"type": "Other"}, {"id": "http://k/j/", "type": "ImageService2"}]}}]}]}]}'
    assert spark.range(1).select(manifest_service(F.lit(body)).alias("u")).first().u == "http://k/j/info.json"


def test_crawl_fails_by_step(spark):
    from tessera.plans import crawl

    site = "http://maps.example.org"
    asked = [(1, f"{site}/a"), (2, f"{site}/a"), (3, f"{site}/none"), (4, f"{site}/lost"), (5, f"{site}/bad"), (6, "ftp://x/y")]
    held = [(f"{site}/a", f"Seadragon.embed('1', '{site}/a.dzi')"), (f"{site}/a.dzi", '<Image TileSize="300" Overlap="2" Format="jpg"><Size Width="310" Height="20"/></Image>'), (f"{site}/none", "<p>nothing</p>")]
    held += [(f"{site}/lost", f"Seadragon.embed('1', '{site}/gone.dzi')"), (f"{site}/bad", f"Seadragon.embed('1', '{site}/b.dzi')"), (f"{site}/b.dzi", "<Image/>"), (f"{site}/a", f"Seadragon.embed('1', '{site}/a.dzi')")]
    rows = crawl.describe(spark.createDataFrame(asked, "request_id long, url string"), spark.createDataFrame(held, "url string, body string"), ["Seadragon"])
    assert {r.request_id: r.failed_at for r in rows.collect()} == {1: None, 2: None, 3: "detect", 4: "fetch", 5: "parse", 6: "detect"}
    assert [r.needs_url for r in rows.filter("failed_at = 'fetch'").collect()] == [f"{site}/gone.dzi"]
    got = sorted((r.request_id, r.px, r.py, r.url) for r in crawl.tiles(rows, ["Seadragon"]).collect())
    assert got == [(i, px, 0, f"{site}/a_files/9/{x}_0.jpg") for i in (1, 2) for x, px in ((0, 0), (1, 298))]
