"""Metadata documents to image descriptors, a parser for each format, as one projection over (request_id, url, body).

Each returns request_id, format, origin, width, height, tile_size and what its URL builder needs; `error` tells of
documents that can't be read. Bodies are parsed by Spark's JSON, XML and pattern functions in the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import MAX_CANVAS_AREA, is_private_ipv4, mercator, parse_float, parse_int, to_int32
from tessera.operators.grid import arg_max, halved_levels, on_canvas

def attribute(path: str, name: str) -> Column:
    body = F.col("body")
    return F.xpath_string(body, F.lit(f"(//*[local-name()='{path}'])[1]/@{name}"))


def _log2_ceil(width: Column, height: Column) -> Column:
    return F.ceil(F.log2(F.greatest(width, height).cast("double"))).cast("int")


def _described(docs: DataFrame, name: str, columns: dict[str, Column], bad: str) -> DataFrame:
    """Columns may use those before them. A row without width, height or tile size is an error."""
    url = F.col("url")
    out = docs.select("request_id", "url", "body").withColumn("format", F.lit(name))
    for k, c in columns.items():
        out = out.withColumn(k, c)
    missing = F.coalesce(F.col("width"), F.lit(0)) * F.coalesce(F.col("height"), F.lit(0)) * F.coalesce(F.col("tile_size"), F.lit(0)) == 0
    return out.withColumn("error", F.when(missing, F.concat(F.lit(bad), F.lit(": "), url))).drop("body", *(k for k in columns if k.startswith("_")))


def zoomify(docs: DataFrame) -> DataFrame:
    """num_tiles counts all levels, or those of full size only. Where the levels' sum differs, the zoom is reckoned anew."""
    url = F.col("url")
    values = {k: parse_int(attribute("IMAGE_PROPERTIES", a)) for k, a in (("width", "WIDTH"), ("height", "HEIGHT"), ("tile_size", "TILESIZE"), ("num_tiles", "NUMTILES"))}
    return _described(docs, "Zoomify", {"origin": url, **values, "max_zoom_level": zoomify_zoom()}, "Invalid Zoomify XML info file")


def zoomify_zoom() -> Column:
    """Null where the tiles of all levels add up to num_tiles."""
    w, h, t = (F.col(c).cast("double") for c in ("width", "height", "tile_size"))
    most = F.ceil(F.log(F.greatest(w, h) / t) / F.log(F.lit(2.0))).cast("int")
    count = lambda z: F.ceil(w / F.pow(F.lit(2.0), z) / t) * F.ceil(h / F.pow(F.lit(2.0), z) / t)
    levels = F.when(most >= 0, F.sequence(F.lit(0), F.greatest(most, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(levels, F.lit(0).cast("bigint"), lambda acc, z: acc + count(z))
    return F.when(total != F.col("num_tiles"), F.ceil(F.log(F.greatest(w, h) / (t + 1)) / F.log(F.lit(2.0))).cast("int"))


def seadragon(docs: DataFrame) -> DataFrame:
    """A .dzi or .xml document, or a page whose image tag holds the geometry."""
    body, url = F.col("body"), F.col("url")
    tag = F.regexp_extract(body, r"(?is)(<img\b(?=[^>]*\bimg_cache\b)(?=[^>]*\bdata-pyr=)(?=[^>]*\bdata-width=)(?=[^>]*\bdata-height=)[^>]*>)", 1)
    of_tag = lambda a: F.regexp_extract(F.col("_tag"), rf"(?i)\b{a}\s*=\s*[\"']([^\"']*)", 1)
    page = F.col("_tag") != ""
    from tessera.functions.text import resolve_relative

    pyramid = resolve_relative(of_tag("data-pyr"), url)
    at = F.when(url.rlike(r"nla\.gov\.au/.*/dzi"), F.concat(url, F.lit("?tile="))).otherwise(F.concat(F.regexp_replace(url, r"\.[^./]*\z", ""), F.lit("_files/")))
    xml = F.when(~page, body)
    of_xml = lambda path, a: F.xpath_string(xml, F.lit(f"(//*[local-name()='{path}'])[1]/@{a}"))
    columns = {
        "_tag": tag,
        "origin": F.when(page, F.when(pyramid.endswith("/"), pyramid).otherwise(F.concat(pyramid, F.lit("/")))).otherwise(at),
        "width": F.when(page, parse_int(of_tag("data-width"))).otherwise(parse_int(of_xml("Size", "Width"))),
        "height": F.when(page, parse_int(of_tag("data-height"))).otherwise(parse_int(of_xml("Size", "Height"))),
        "tile_size": F.when(page, 256).otherwise(parse_int(of_xml("Image", "TileSize"))),
        "overlap": F.when(page, 1).otherwise(parse_int(of_xml("Image", "Overlap"))).cast("int"),
        "image_format": F.when(page, "jpg").otherwise(of_xml("Image", "Format")),
        "max_zoom_level": _log2_ceil(F.col("width"), F.col("height")),
    }
    return _described(docs, "Seadragon", columns, "Invalid Deep Zoom info file")


def iipimage(docs: DataFrame) -> DataFrame:
    body, url = F.col("body"), F.col("url")
    number = lambda p, g=1: F.regexp_extract(body, p, g).try_cast("bigint")
    columns = {"origin": F.regexp_extract(url, r"^(.*\?FIF=[^&]*)", 1), "width": number(r"Max-size:(\d+) (\d+)"), "height": number(r"Max-size:(\d+) (\d+)", 2), "tile_size": number(r"Tile-size:(\d+) (\d+)"), "max_zoom_level": (number(r"Resolution-number:(\d+)") - 1).cast("int")}
    return _described(docs, "IIPImage", columns, "Invalid IIPImage information file")


def _pff_number(body: Column, name: str) -> Column:
    return F.regexp_extract(body, rf"(?i){name}=.(\d+)", 1).try_cast("bigint")


def pff_index(body: Column) -> tuple[Column, Column]:
    """Where the index of a single-file pyramid lies, by its header: after 0x424 bytes and the header, 8 bytes a tile."""
    begin = F.lit(0x424) + _pff_number(body, "headerSize")
    return begin, begin + 8 * _pff_number(body, "numTiles")


def zoomify_pff(docs: DataFrame) -> DataFrame:
    """body holds both replies, the header and the index, one after the other, as plans.crawl fetches them."""
    body, url = F.col("body"), F.col("url")
    number = lambda k: _pff_number(body, k)
    base = F.regexp_extract(body, r"reply_data=(\d+)", 1).try_cast("bigint")
    fields = F.regexp_extract_all(F.regexp_extract(body, r"reply_data=\d+,([^,]*)", 1), F.lit(r"([ \d]{9})"), F.lit(1))
    columns = {"origin": url, "width": number("width"), "height": number("height"), "tile_size": number("tileSize"), "num_tiles": number("numTiles"), "header_size": number("headerSize"), "index_end": pff_index(body)[1], "offsets": F.transform(fields, lambda f: F.trim(f).try_cast("bigint") + base)}
    return _described(docs, "Zoomify PFF", columns, "Invalid PFF header or index")


def xlimage(docs: DataFrame) -> DataFrame:
    body, url = F.col("body"), F.col("url")
    number = lambda tag: parse_int(F.xpath_string(body, F.lit(f"(//{tag})[1]")))
    return _described(docs, "XLimage", {"origin": F.regexp_replace(url, r"\?cmd=info.*\z", ""), "width": number("width"), "height": number("height"), "tile_size": number("tileside"), "max_zoom_level": F.lit(1)}, "Invalid XLimage info file")


def topviewer(docs: DataFrame) -> DataFrame:
    body, url = F.col("body"), F.col("url")
    kind = "topviews array<struct<filepath:string,width:bigint,height:bigint,tileWidth:int,layers:array<struct<no:int,width:bigint,starttile:bigint,cols:int>>>>, config struct<tileurl_v2:string>"
    view = F.get(F.col("_json.topviews"), 0)
    once = lambda text, mark, value: F.concat(F.substring_index(text, mark, 1), value, F.substring(text, F.length(F.substring_index(text, mark, 1)) + len(mark) + 1, F.length(text)))
    template = F.col("_json.config.tileurl_v2")
    filled = F.when(template.contains("{file}"), once(template, "{file}", view["filepath"])).otherwise(template)
    columns = {"_json": F.from_json(body, kind), "_layer": arg_max(view["layers"], lambda x: x["width"]), "origin": url, "width": view["width"], "height": view["height"], "tile_size": view["tileWidth"], "max_zoom_level": F.col("_layer.no"), "_filled": filled, "url_template": F.when(F.col("_filled").contains("{extension}"), once(F.col("_filled"), "{extension}", F.lit("jpg"))).otherwise(F.col("_filled")), "first_tile": F.col("_layer.starttile"), "cols": F.col("_layer.cols")}
    return _described(docs, "TopViewer", columns, "Invalid TopViewer file")


#: What is read of a scene's document.
SCENE = "image array<struct<_tilesize:string,_baseindex:string,level:array<struct<_tiledimagewidth:string,_tiledimageheight:string,front:struct<_url:string>,left:struct<_url:string>,cube:struct<_url:string>,flat:struct<_url:string>>>,cube:array<struct<_url:string,_multires:string>>,flat:array<struct<_url:string,_multires:string>>,cylinder:array<struct<_url:string,_multires:string>>,sphere:array<struct<_url:string,_multires:string>>>>, include array<struct<_url:string>>"


def scene_includes(body: Column) -> Column:
    """The URLs of the documents that a scene includes, in order."""
    return F.transform(F.from_xml(body, SCENE)["include"], lambda x: x["_url"])


def scene_levels(body: Column) -> Column:
    """The levels of a scene's images, from multires lists or level tags, in order."""
    none = F.array().cast("array<struct<width:int,height:int,tile_size:int,url:string,base_index:int,level_index:int>>")

    def of_image(im: Column) -> Column:
        base = F.coalesce(parse_int(im["_baseindex"]), F.lit(1)).cast("int")

        def of_multires(el: Column) -> Column:
            parts = F.split(el["_multires"], ",")

            def level(part: Column, k: Column) -> Column:
                size = F.split(part, "x")
                own = to_int32(F.coalesce(F.get(size, 2), F.lit("")))
                tile = F.when(own != 0, own).otherwise(parse_int(F.get(parts, 0)).cast("int"))
                return F.struct(to_int32(F.get(size, 0)).alias("width"), to_int32(F.coalesce(F.get(size, 1), F.lit(""))).alias("height"), tile.alias("tile_size"), el["_url"].alias("url"), base.alias("base_index"), (k + base).alias("level_index"))

            return F.when(el["_multires"].isNotNull(), F.transform(F.slice(parts, 2, F.size(parts)), level)).otherwise(none)

        def of_level(el: Column, k: Column) -> Column:
            side = F.coalesce(el["front"]["_url"], el["left"]["_url"], el["cube"]["_url"], el["flat"]["_url"])
            return F.struct(to_int32(el["_tiledimagewidth"]).alias("width"), to_int32(el["_tiledimageheight"]).alias("height"), to_int32(im["_tilesize"]).alias("tile_size"), side.alias("url"), base.alias("base_index"), (k + base).alias("level_index"))

        kinds = [F.flatten(F.transform(F.coalesce(im[k], F.array().cast("array<struct<_url:string,_multires:string>>")), of_multires)) for k in ("cube", "flat", "cylinder", "sphere")]
        return F.concat(*kinds, F.coalesce(F.transform(im["level"], of_level), none))

    return F.flatten(F.transform(F.coalesce(F.from_xml(body, SCENE)["image"], F.array()), of_image))


def krpano(docs: DataFrame) -> DataFrame:
    """Levels from multires lists or level tags; the widest wins, the last of equals. Tile counts are rounded.

    Documents that name no level but include others give an error and the first included URL in `needs_url`; plans.crawl
    follows them.
    """
    body, url = F.col("body"), F.col("url")
    best = arg_max(F.col("_levels"), lambda x: x["width"], last=True)
    columns = {"_levels": scene_levels(body), "_best": best, "origin": url}
    columns |= {"width": F.col("_best.width").cast("bigint"), "height": F.col("_best.height").cast("bigint"), "tile_size": F.col("_best.tile_size"), "url_template": F.col("_best.url"), "base_index": F.col("_best.base_index"), "level_index": F.col("_best.level_index")}
    columns |= {f"nbr_tiles_{k}": F.floor(F.col(side) / F.col("tile_size").cast("double") + 0.5).cast("int") for k, side in (("x", "width"), ("y", "height"))}
    columns |= {"needs_url": F.when(F.size("_levels") == 0, F.get(scene_includes(body), 0))}
    return _described(docs, "krpano", columns, "Unable to find level information")


def iiif_origin(own: Column) -> Column:
    """Where an image's tiles are: its id, unless that is missing, private or names another port of the same host."""
    url = F.col("url")
    own = F.regexp_replace(own, r"^https?, (https?://)", "$1")
    part = lambda u, name: F.try_parse_url(u, F.lit(name))
    port = F.regexp_extract(own, r"(?i)^https?://(?:\[[^\]]+\]|[^/?#:]+):(\d+)(?:[/?#]|\z)", 1)
    host, scheme = part(own, "HOST"), part(own, "PROTOCOL")
    here_host, here_scheme = part(url, "HOST"), part(url, "PROTOCOL")
    authority = lambda u, s: F.regexp_replace(part(u, "AUTHORITY"), r":(?:80|443)\z", "")
    same = (scheme == here_scheme) & (authority(own, scheme) == authority(url, here_scheme))
    moved = (host == here_host) & ~same & (port.isin("80", "443") | ((scheme == "http") & (here_scheme == "https") & (port == "")))
    rest = F.regexp_replace(own, r"^https?://[^/?#]*", "")
    normal = F.concat(scheme, F.lit("://"), F.when(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), host).otherwise(part(own, "AUTHORITY")), rest)
    repaired = F.concat(here_scheme, F.lit("://"), part(url, "AUTHORITY"), rest)
    bad = own.isNull() | (own == "") | host.isNull() | host.isin("localhost", "example.com") | is_private_ipv4(host)
    return F.when(bad, F.regexp_replace(url, r"/info\.json(\?.*)?\z", "")).when(moved, repaired).otherwise(normal)


def iiif(docs: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """probes (url, ok, width, height) may hold the real size of first tiles, which replaces the declared one."""
    body = F.col("body")
    kind = "`@id` string, id string, width string, height string, tile_width int, tiles array<struct<width:int,scaleFactors:array<int>>>, qualities array<string>, formats array<string>"
    tiles = F.col("_json.tiles")
    # The smallest of a tile's scale factors; the later of equals. Missing factors compare as infinity.
    least = F.array_min(F.transform(tiles, lambda t, i: F.struct(F.coalesce(F.array_min(t["scaleFactors"]), F.lit(2**31 - 1)).alias("v"), (-i).alias("i"), t.alias("t"))))["t"]
    wanted = lambda name, first, default: F.when(F.coalesce(F.size(F.col(name)), F.lit(0)) <= 0, default).when(F.array_contains(F.col(name), first), first).otherwise(F.get(F.col(name), 0))
    declared = F.when(F.col("_json.tile_width") < F.col("width"), F.col("_json.tile_width")).otherwise(512)
    columns = {
        "_json": F.from_json(body, kind), "origin": iiif_origin(F.coalesce(F.nullif(F.col("_json.@id"), F.lit("")), F.col("_json.id"))), "width": parse_int(F.col("_json.width")), "height": parse_int(F.col("_json.height")),
        "tile_size": F.when(F.size(tiles) > 0, least["width"]).otherwise(declared).cast("int"), "max_zoom_level": F.when(F.size(tiles) > 0, F.array_min(least["scaleFactors"])).otherwise(1),
        "quality": wanted("_json.qualities", "native", "default"), "image_format": wanted("_json.formats", "png", "jpg"),
    }
    out = _described(docs, "IIIF", columns, "Invalid IIIF info file")
    if probes is None:
        return out
    from tessera.operators.tileurl import iiif as tile

    first = out.withColumns({"x": F.lit(0), "y": F.lit(0)}).withColumn("_first", tile()).drop("x", "y")
    seen = probes.filter("ok").select(F.col("url").alias("_first"), F.greatest("width", "height").alias("_real"))
    return first.join(seen, "_first", "left").withColumn("tile_size", F.coalesce("_real", "tile_size")).drop("_first", "_real")


def fsi(docs: DataFrame) -> DataFrame:
    body, url = F.col("body"), F.col("url")
    number = lambda k: F.regexp_extract(body, rf"(?i){k}\s+value=[\"']?(\d+)", 1).try_cast("bigint")
    return _described(docs, "FSI", {"origin": F.regexp_replace(url, r"/server\?.*", "/server"), "source": F.regexp_extract(url, r"source=([^&]+)", 1), "width": number("width"), "height": number("height"), "tile_size": F.lit(512)}, "Invalid FSI info")


def lizardtech(docs: DataFrame) -> DataFrame:
    body, url = F.col("body"), F.col("url")
    of = lambda path: F.nullif(F.xpath_string(body, F.lit(path)), F.lit(""))
    parameter = lambda name: of(f"(//Parameter[@name='{name}'])[1]")
    host = F.coalesce(of("(//ImageServer)[1]/@host"), F.try_parse_url(url, F.lit("AUTHORITY")), F.regexp_extract(url, r"^\w+://([^/?#]+)", 1))
    path = F.regexp_replace(F.coalesce(of("(//ImageServer)[1]/@path"), F.lit("lizardtech/iserv")), r"^/|/\z", "")
    item = F.coalesce(parameter("item"), F.concat_ws("/", of("(//Image)[1]/@parent"), of("(//Image)[1]/@name")))
    columns = {
        "origin": F.concat(F.regexp_extract(url, r"^(\w+:)", 1), F.lit("//"), host, F.lit("/"), path, F.lit("/calcrgn")), "catalog": F.coalesce(of("(//Catalog)[1]/@name"), parameter("cat"), F.lit("")), "item": item,
        "width": parse_int(of("(//Image)[1]/@width")), "height": parse_int(of("(//Image)[1]/@height")), "tile_size": F.lit(512), "levels": halved_levels(F.col("width"), F.col("height")), "max_zoom_level": F.size("levels") - 1,
    }
    return _described(docs, "LizardTech", columns, "Invalid LizardTech ImageServer XML")


def vls(docs: DataFrame) -> DataFrame:
    """The height is rounded up to whole tiles of the size that the document names; tiles are 1024 all the same."""
    body, url = F.col("body"), F.col("url")
    of = lambda name: F.xpath_string(body, F.lit(f"(//*[@id='map'])[1]/@*[local-name()='{name}' or name()='vls:{name}']"))
    tile = parse_int(F.xpath_string(body, F.lit("(//*[local-name()='var'][@id='zoomTileSize'])[last()]/@value")))
    height = parse_int(of("height"))
    columns = {"origin": url, "path": F.concat(F.lit("/image/tiler/square/"), F.nullif(of("ot_id"), F.lit("")), F.lit("/0")), "width": parse_int(of("width")), "height": ((F.floor((height - 1) / tile.cast("double")) + 1) * tile).cast("bigint"), "tile_size": F.lit(1024)}
    return _described(docs, "VLS", columns, "Unable to extract image ID")


def micrio(docs: DataFrame) -> DataFrame:
    """Of the levels, each keeps its place unless the next is neither narrower nor lower."""
    body = F.col("body")
    kind = "levels array<struct<width:bigint,height:bigint,tiles:array<struct<x:int,y:int,url:string>>>>"
    levels = F.col("_json.levels")
    start = F.struct(F.lit(0).cast("bigint").alias("width"), F.lit(0).cast("bigint").alias("height"), F.array().cast("array<struct<x:int,y:int,url:string>>").alias("tiles"))
    best = F.aggregate(levels, start, lambda a, b: F.when((a["width"] > b["width"]) | (a["height"] > b["height"]), a).otherwise(b))
    named = F.transform(F.col("_best.tiles"), lambda t: F.struct(F.concat_ws(",", t["x"], t["y"]).alias("key"), t["url"].alias("value")))
    # Of tiles named twice the last counts.
    lasting = F.filter(named, lambda t, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda u: u["key"] == t["key"]))
    columns = {"_json": F.from_json(body, kind), "_best": best, "origin": F.lit(None).cast("string"), "width": F.col("_best.width"), "height": F.col("_best.height"), "tile_size": F.lit(512), "tile_map": F.map_from_entries(lasting)}
    return _described(docs, "Micrio", columns, "Invalid Micrio tile info")


def generic(probed: DataFrame) -> DataFrame:
    """From probes (request_id, url template, x, y, ok, width, height): counts by the tiles of row 0 and column 0 that exist.

    Equal to a bisection of (0, 1000) on either axis where the tiles of a row are contiguous.
    """
    loaded = probed.filter("ok").groupBy("request_id", "url").agg(F.max(F.when(F.col("y") == 0, F.col("x"))).alias("mx"), F.max(F.when(F.col("x") == 0, F.col("y"))).alias("my"), F.max(F.least("width", "height")).alias("side"))
    tile = F.greatest(F.lit(256), F.coalesce("side", F.lit(256)))
    sizes = [(F.greatest(F.coalesce(c, F.lit(0)) + 1, F.lit(1)) * tile).cast("bigint") for c in ("mx", "my")]
    return loaded.select("request_id", "url", F.lit("Generic").alias("format"), F.col("url").alias("origin"), sizes[0].alias("width"), sizes[1].alias("height"), tile.cast("int").alias("tile_size"), F.lit(None).cast("string").alias("error"))


def arts_culture(docs: DataFrame) -> DataFrame:
    """The last level that fits the canvas."""
    body, url = F.col("body"), F.col("url")
    kind = "_tile_width int, _tile_height int, pyramid_level array<struct<_num_tiles_x:int,_num_tiles_y:int,_empty_pels_x:int,_empty_pels_y:int>>"
    tw, th = F.col("_xml._tile_width"), F.col("_xml._tile_height")
    levels = F.transform(F.col("_xml.pyramid_level"), lambda v, i: F.struct((v["_num_tiles_x"].cast("bigint") * tw - v["_empty_pels_x"]).alias("width"), (v["_num_tiles_y"].cast("bigint") * th - v["_empty_pels_y"]).alias("height"), (v["_num_tiles_x"] * v["_num_tiles_y"]).alias("num_tiles"), i.alias("level")))
    columns = {"_xml": F.from_xml(body, kind), "_best": F.try_element_at(on_canvas(levels), F.lit(-1)), "origin": url, "width": F.col("_best.width"), "height": F.col("_best.height"), "tile_size": tw, "num_tiles": F.col("_best.num_tiles"), "max_zoom_level": F.col("_best.level")}
    return _described(docs, "Arts & Culture", columns, "Invalid XML info file")


def hungaricana(docs: DataFrame) -> DataFrame:
    body, url = F.col("body"), F.col("url")
    path = F.regexp_extract(url, r"^.*?imagesize/(.*?)(?:imagesize/.*)?\z", 1)
    columns = {"_json": F.from_json(body, "width bigint, height bigint"), "path": path, "origin": F.concat(F.regexp_extract(url, r"^(.*?)imagesize/", 1), F.lit("image/"), path, F.lit("/")), "width": F.col("_json.width"), "height": F.col("_json.height"), "tile_size": F.lit(512)}
    return _described(docs, "Hungaricana", columns, "Invalid image size")


def mnesys(docs: DataFrame) -> DataFrame:
    """The layer of the largest z; its place, not its z, names the level."""
    body, url = F.col("body"), F.col("url")
    values = {k: F.xpath(body, F.lit(f"//layer/@{k}")) for k in "zwht"}
    layers = F.transform(F.arrays_zip(*(v.alias(k) for k, v in values.items())), lambda v, i: F.struct(parse_int(v["z"]).alias("z"), parse_int(v["w"]).alias("w"), parse_int(v["h"]).alias("h"), parse_int(v["t"]).alias("t"), i.alias("i")))
    columns = {"_best": arg_max(layers, lambda v: v["z"]), "origin": url, "width": F.col("_best.w"), "height": F.col("_best.h"), "tile_size": F.col("_best.t"), "max_zoom_level": F.col("_best.i")}
    return _described(docs, "Mnesys", columns, "No layer in image")


def wmts(docs: DataFrame) -> DataFrame:
    """The first layer in the first Web Mercator matrix set: its widest level that fits the canvas, cut to its bounds."""
    body = F.col("body")
    layer = "(//*[local-name()='Layer'])[1]"
    one = lambda path: F.nullif(F.xpath_string(body, F.lit(path)), F.lit(""))
    box = lambda kind: f"({layer}//*[local-name()='{kind}'])[1]"
    corner = lambda name: F.coalesce(one(f"{box('BoundingBox')}/*[local-name()='{name}']"), one(f"{box('WGS84BoundingBox')}/*[local-name()='{name}']"))
    number = r"-?[\d.Ee+\-]+"
    pair = lambda c: [F.regexp_extract(c, rf"({number})\s+({number})", g).try_cast("double") for g in (1, 2)]
    crs = F.coalesce(one(f"{box('BoundingBox')}/@crs"), one(f"{box('WGS84BoundingBox')}/@crs"))
    metres = crs == "urn:ogc:def:crs:EPSG::3857"
    degrees = crs.isin("urn:ogc:def:crs:OGC:2:84", "urn:ogc:def:crs:EPSG::4326")
    chosen = f"({layer}/../*[local-name()='TileMatrixSet'][*[local-name()='SupportedCRS']='urn:ogc:def:crs:EPSG::3857'])[1]"
    many = lambda name: F.xpath(body, F.lit(f"{chosen}/*[local-name()='TileMatrix']/*[local-name()='{name}']/text()"))
    (x0, y0), (x1, y1) = pair(corner("LowerCorner")), pair(corner("UpperCorner"))
    (mx0, my1), (mx1, my0) = mercator(x0, y1), mercator(x1, y0)
    pick = lambda a, b: F.when(metres, a).when(degrees, b)

    def level(m: Column) -> Column:
        left, top = (F.regexp_extract(m["at"], rf"({number})\s+({number})", g).try_cast("double") for g in (1, 2))
        tile = parse_float(m["tile"])
        span = tile * parse_float(m["scale"]) * 0.28e-3
        place = lambda v: F.floor(v / span).cast("bigint")
        a, b, c, d = place(F.col("_x0") - left), place(top - F.col("_y1")), place(F.col("_x1") - left), place(top - F.col("_y0"))
        return F.struct(((c + 1 - a) * tile.cast("bigint")).alias("width"), ((d + 1 - b) * tile.cast("bigint")).alias("height"), tile.cast("int").alias("tile_size"), m["id"].alias("id"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), (tile == parse_float(m["high"])).alias("square"))

    names = {"id": "Identifier", "scale": "ScaleDenominator", "at": "TopLeftCorner", "tile": "TileWidth", "high": "TileHeight"}
    levels = F.transform(F.arrays_zip(*(many(v).alias(k) for k, v in names.items())), level)
    best = arg_max(on_canvas(F.col("_levels"), MAX_CANVAS_AREA), lambda v: v["width"])
    context = F.create_map(F.lit("TileMatrix"), F.col("_best.id"), F.lit("TileMatrixSet"), one(f"{chosen}/*[local-name()='Identifier']"), F.lit("Style"), F.coalesce(one(f"({layer}//*[local-name()='Style'])[1]//*[local-name()='Identifier']"), F.lit("default")))
    columns = {
        "_x0": pick(x0, mx0), "_y1": pick(y1, my1), "_x1": pick(x1, mx1), "_y0": pick(y0, my0), "_levels": levels, "_best": F.when(~F.exists("_levels", lambda v: ~v["square"]), best), "origin": F.lit(None).cast("string"),
        "width": F.col("_best.width"), "height": F.col("_best.height"), "tile_size": F.col("_best.tile_size"), "max_zoom_level": F.lit(1), "url_template": one(f"({layer}//*[local-name()='ResourceURL'])[1]/@template"), "context": context,
        "tile_min_col": F.col("_best.a"), "tile_min_row": F.col("_best.b"), "tile_max_col": F.col("_best.c"), "tile_max_row": F.col("_best.d"),
    }
    return _described(docs, "WMTS", columns, "No supported tile matrix set or bounds")


def pnav(docs: DataFrame) -> DataFrame:
    """For docs with the page's body, source_width and source_height of its image document, and probe_width of the first tile."""
    image = F.regexp_extract(F.col("page"), r"<meta property=\"og:image\" content=\"(.*?)\?w=1000&h=1000", 1)
    ratio = F.col("probe_width") / F.lit(512.0)
    scaled = lambda side: F.floor(F.col("probe_width") * F.floor(F.col(side) / F.lit(512.0)) + (F.col(side) % 512) * ratio + 0.5).cast("bigint")
    out = docs.withColumns({"format": F.lit("pnav"), "origin": F.nullif(image, F.lit("")), "width": scaled("source_width"), "height": scaled("source_height"), "tile_size": F.col("probe_width").cast("int"), "max_zoom_level": F.lit(1), "ratio": ratio})
    return out.withColumn("error", F.when(F.col("origin").isNull(), "The page names no image."))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Zoomify": zoomify, "Seadragon": seadragon, "IIPImage": iipimage, "Zoomify PFF": zoomify_pff, "XLimage": xlimage, "TopViewer": topviewer, "krpano": krpano, "IIIF": iiif, "FSI": fsi,
    "LizardTech": lizardtech, "VLS": vls, "Micrio": micrio, "Arts & Culture": arts_culture, "Hungaricana": hungaricana, "Mnesys": mnesys, "WMTS": wmts,
}


def parse(docs: DataFrame, formats: list[str] | None = None, parsers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Descriptors of docs (request_id, url, format, body), all formats in one table; columns that a format lacks are null.

    Each row is in the result once: rows of formats without a parser, or of none, are errors. Those of Generic and pnav
    need probes of their tiles and go through generic() and pnav(). parsers are those of another registry than the built-in
    one.
    """
    parsers = PARSERS if parsers is None else parsers
    names = [n for n in formats or parsers if n in parsers]
    known = F.coalesce(F.col("format").isin(names), F.lit(False)) if names else F.lit(False)
    reason = F.when(F.col("format").isin("Generic", "pnav"), "This format needs probes: ").otherwise("No parser for this format: ")
    out = docs.filter(~known).select("request_id", "url", "format", F.concat(reason, F.coalesce("format", F.lit("none"))).alias("error"))
    for name in names:
        out = out.unionByName(parsers[name](docs.filter(F.col("format") == name)), allowMissingColumns=True)
    return out
