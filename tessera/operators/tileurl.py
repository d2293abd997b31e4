"""The URL of each tile, a Column expression for each format.

A builder takes the columns of a planned tile: x, y, zoom, nbr_tiles_x, width, height, tile_size, origin and what its
format adds. register_format() adds formats of one's own; with_tile_urls() picks the builder by the column `format`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import char_code_sum, encode_uri_component, js_number, link_base, pad_left, resolve_relative
from tessera.operators.grid import crops

def text(c: Column) -> Column:
    return c.cast("string")


def index() -> Column:
    x, y = F.col("x"), F.col("y")
    return x + y * F.col("nbr_tiles_x")


def zoomify() -> Column:
    """TileGroups count 256 tiles over all levels; those of full size come last, unless num_tiles counts them alone."""
    x, y = F.col("x"), F.col("y")
    total = F.col("nbr_tiles_x").cast("bigint") * F.col("nbr_tiles_y")
    only = F.col("num_tiles") == F.ceil(F.col("width") / F.col("tile_size").cast("double")) * F.ceil(F.col("height") / F.col("tile_size").cast("double"))
    group = F.when(only, 0).otherwise(F.floor((F.col("num_tiles") - total + index()) / F.lit(256.0)))
    return F.concat(F.lit("TileGroup"), text(group), F.lit("/"), text(F.col("zoom")), F.lit("-"), text(x), F.lit("-"), text(y), F.lit(".jpg"))


def deep_zoom() -> Column:
    x, y = F.col("x"), F.col("y")
    return F.concat(F.col("origin"), text(F.col("zoom")), F.lit("/"), text(x), F.lit("_"), text(y), F.lit("."), F.col("image_format"))


def iip() -> Column:
    return F.concat(F.col("origin"), F.lit("&JTL="), text(F.col("zoom")), F.lit(","), text(index()))


def byte_range() -> tuple[Column, Column]:
    """Where a tile lies in a single-file pyramid: from the end of the one before, or of the index."""
    k = index().cast("int")
    return F.when(k > 0, F.get(F.col("offsets"), k - 1)).otherwise(F.col("index_end")), F.get(F.col("offsets"), k)


def pff() -> Column:
    begin, end = byte_range()
    return F.concat(F.col("origin"), F.lit("&requestType=0&head="), text(F.col("header_size")), F.lit("&begin="), text(begin), F.lit("&end="), text(end))


def xlimage() -> Column:
    x, y = F.col("x"), F.col("y")
    return F.concat(F.col("origin"), F.lit("?cmd=tile&x="), text(x), F.lit("&y="), text(y), F.lit("&z="), text(F.col("zoom")))


def topviewer() -> Column:
    x, y = F.col("x"), F.col("y")
    return F.replace(F.col("url_template"), F.lit("{tile}"), text(F.col("first_tile") + x + y * F.col("cols")))


KRPANO_KEY, GENERIC_KEY = r"%(0*[a-z%])", r"\{\{((?:[XYxy])(?::.\d+)?)\}\}"
#: Where the template of a format is, and what stands for a value in it.
TEMPLATES = {"krpano": ("url_template", KRPANO_KEY), "Generic": ("origin", GENERIC_KEY)}
#: Of what stands for a value: whether it is known, its axis (null: the same for all tiles), that same value, and the width and sign to pad with.
PLACES = {
    "krpano": (
        lambda key: F.right(key, F.lit(1)).isin(*"hxucvyrl%sf"),
        lambda key: F.when(F.right(key, F.lit(1)).isin(*"hxuc"), "x").when(F.right(key, F.lit(1)).isin(*"vyr"), "y"),
        lambda key: F.when(key.endswith("l"), text(F.col("level_index"))).when(key.endswith("%"), "%").when(key.endswith("s"), "f").when(key.endswith("f"), "1"),
        F.length,  # of the zeros and the letter
        lambda key: F.lit("0"),
    ),
    "Generic": (
        lambda key: F.lit(True),
        lambda key: F.when(F.lower(F.left(key, F.lit(1))) == "x", "x").when(key.isNotNull(), "y"),
        lambda key: F.lit(None).cast("string"),
        lambda key: F.coalesce(F.substring(key, 4, 20).try_cast("int"), F.lit(0)),
        lambda key: F.substring(key, 3, 1),
    ),
}


#: Places of a template that a tile's expression holds one by one; longer templates are folded.
UNROLLED = 4
PARTS = "array<struct<gap:string,axis:string,width:int,sign:string>>"


def template_parts(column: str, name: str) -> Column:
    """array<struct(gap, axis, width, sign)> of a template of TEMPLATES: the text before each place where a tile's x or y is written.

    What is the same for all tiles of an image is in the gaps. A place is padded to width with sign; the last one has no
    axis. Null for templates with places of another kind.
    """
    pattern = TEMPLATES[name][1]
    keys = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))
    kind, axis, fixed, width, sign = PLACES[name]

    def add(acc: Column, p: Column) -> Column:
        key = p["key"]
        text_ = F.concat(acc["held"], p["gap"], F.when(key.isNull() | axis(key).isNotNull(), "").otherwise(pad_left(fixed(key), width(key), sign(key))))
        place = F.struct(text_.alias("gap"), axis(key).alias("axis"), width(key).cast("int").alias("width"), sign(key).alias("sign"))
        return F.when(axis(key).isNull(), F.struct(text_.alias("held"), acc["done"].alias("done"))).otherwise(F.struct(F.lit("").alias("held"), F.concat(acc["done"], F.array(place)).alias("done")))

    none = F.lit(None).cast("string")
    start = F.struct(F.lit("").alias("held"), F.array().cast(PARTS).alias("done"))
    end = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["held"].alias("gap"), none.alias("axis"), F.lit(0).alias("width"), none.alias("sign"))))
    found = F.aggregate(F.arrays_zip(F.split(F.col(column), pattern, -1).alias("gap"), keys.alias("key")), start, add, end)
    return F.when(~F.exists(keys, lambda k: ~kind(k)), found).cast(PARTS)


def with_template_parts(images: DataFrame, name: str) -> DataFrame:
    """Adds template_parts to descriptors of a format of TEMPLATES, so that a template is split once an image and not for each tile."""
    return images.withColumn("template_parts", template_parts(TEMPLATES[name][0], name))


def filled(parts: Column, x: Column, y: Column) -> Column:
    """A tile's URL by its template's parts and the texts of its place. The first places are plain expressions, which Spark compiles."""

    def place(p: Column) -> Column:
        value = F.when(p["axis"] == "x", x).when(p["axis"] == "y", y)
        return F.when(p["axis"].isNull(), p["gap"]).otherwise(F.concat(p["gap"], F.lpad(value, F.greatest(p["width"], F.length(value)), p["sign"])))

    first = F.concat(*(F.when(F.size(parts) > k, place(F.get(parts, F.lit(k)))).otherwise("") for k in range(UNROLLED)))
    return F.when(F.size(parts) <= UNROLLED, first).otherwise(F.aggregate(parts, F.lit(""), lambda acc, p: F.concat(acc, place(p))))


def krpano(parts: Column | None = None) -> Column:
    """%h %x %u %c are the column, %v %y %r the row, %l the level, %s the side, %f the frame; zeros before a letter pad.

    As many widths as the template uses are filled; %% is a percent sign. Templates with other letters give null.
    """
    base = F.coalesce(F.col("base_index"), F.lit(1))
    return filled(template_parts("url_template", "krpano") if parts is None else parts, text(F.col("x") + base), text(F.col("y") + base))


def iiif() -> Column:
    x, y = F.col("x"), F.col("y")
    px, py = x * F.col("tile_size"), y * F.col("tile_size")
    sx, sy = crops(F.col("width"), F.col("height"), x, y, F.col("tile_size"))
    region, size = F.concat_ws(",", text(px), text(py), text(sx), text(sy)), F.concat_ws(",", text(sx), text(sy))
    return F.concat(F.concat_ws("/", F.col("origin"), region, size, F.lit("0"), F.col("quality")), F.lit("."), F.col("image_format"))


def fsi_rect() -> list[Column]:
    """Left, top, width and height of a tile as parts of the image."""
    x, y = F.col("x"), F.col("y")
    sx, sy = crops(F.col("width"), F.col("height"), x, y, F.col("tile_size"))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    return [x * F.col("tile_size") / w, y * F.col("tile_size") / h, sx / w, sy / h]


def fsi() -> Column:
    x, y = F.col("x"), F.col("y")
    sx, sy = crops(F.col("width"), F.col("height"), x, y, F.col("tile_size"))
    head = F.concat(F.col("origin"), F.lit("?type=image&source="), F.col("source"), F.lit("&width="), text(sx), F.lit("&height="), text(sy), F.lit("&rect="))
    return F.concat(head, F.concat_ws(",", *map(js_number, fsi_rect())))


def lizardtech_centre() -> list[Column]:
    x, y = F.col("x"), F.col("y")
    level = F.get(F.col("levels"), F.col("zoom"))
    return [((k + 0.5) * F.col("tile_size")) / level[side] - level[d] for k, side, d in ((x, "width", "dx"), (y, "height", "dy"))]


def lizardtech() -> Column:
    """Null where zoom is no level, as for images of at most a tile."""
    level = F.get(F.col("levels"), F.col("zoom"))
    head = F.concat(F.regexp_replace(F.col("origin"), r"/calcrgn\z", "/getimage"), F.lit("?cat="), encode_uri_component(F.col("catalog")), F.lit("&item="), encode_uri_component(F.col("item")))
    url = F.concat(head, F.lit("&wid=512&hei=512&oif=jpeg&lev="), text(level["level"]), F.lit("&cp="), F.concat_ws(",", *map(js_number, lizardtech_centre())))
    return F.when((F.col("zoom") >= 0) & (F.col("zoom") < F.size("levels")), url)


def vls() -> Column:
    x, y = F.col("x"), F.col("y")
    return F.concat_ws("/", F.col("path"), text(x), text(y))


def from_map() -> Column:
    """Micrio: the URL that the metadata names for a tile; null where there is none."""
    x, y = F.col("x"), F.col("y")
    return F.try_element_at(F.col("tile_map"), F.concat_ws(",", text(x), text(y)))


def generic(parts: Column | None = None) -> Column:
    """{{X}} and {{Y}}, in either case, with an optional sign and width to pad to: {{X:04}} pads with 0 to 4."""
    return filled(template_parts("origin", "Generic") if parts is None else parts, text(F.col("x")), text(F.col("y")))


def mnesys() -> Column:
    return F.concat(text(F.col("zoom")), F.lit("_"), text(index()), F.lit(".jpg"))


def wmts() -> Column:
    """Fills the template from the context and the tile's place; unknown names stay. Null outside the tile range."""
    x, y = F.col("x"), F.col("y")
    known = F.map_concat(F.col("context"), F.create_map(F.lit("TileCol"), text(F.col("tile_min_col") + x), F.lit("TileRow"), text(F.col("tile_min_row") + y)))
    pattern = r"\{([^}]+)\}"
    gaps, keys = F.split(F.col("url_template"), pattern, -1), F.regexp_extract_all(F.col("url_template"), F.lit(pattern), F.lit(1))
    filled = F.transform(keys, lambda k: F.coalesce(F.try_element_at(known, k), F.concat(F.lit("{"), k, F.lit("}"))))
    url = F.array_join(F.zip_with(gaps, F.concat(filled, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    inside = (F.col("tile_min_col") + x <= F.col("tile_max_col")) & (F.col("tile_min_row") + y <= F.col("tile_max_row"))
    return F.when(inside & (x >= 0) & (y >= 0), url)


def pnav(tile: int = 512) -> Column:
    """Crops of one image; those without width or height are null. ratio is how much larger the server's tiles are."""
    x, y = F.col("x"), F.col("y")
    steps = [F.floor(F.col(side) / F.lit(float(tile))) for side in ("source_width", "source_height")]
    rest = [F.col(side) % tile for side in ("source_width", "source_height")]
    cw, ch = (F.when(k == n, r).otherwise(tile) for k, n, r in zip((x, y), steps, rest, strict=True))
    last = (x == steps[0]) & (y == steps[1])
    full = lambda r: F.ceil(r * F.col("ratio")).cast("bigint")
    w, h = (F.when(last, full(r)).otherwise(2000) for r in rest)
    parts = [F.col("origin"), F.lit("?w="), text(w), F.lit("&h="), text(h), F.lit("&cl="), text(x * tile), F.lit("&ct="), text(y * tile), F.lit("&cw="), text(cw), F.lit("&ch="), text(ch)]
    return F.when((cw > 0) & (ch > 0) & (x <= steps[0]) & (y <= steps[1]), F.concat(*parts))


def hungaricana(key: str) -> Column:
    """The first AES-CBC block of "sum|zoom|x|y", padded with stars, in hex. The caller supplies the 16-byte key."""
    x, y = F.col("x"), F.col("y")
    plain = F.concat_ws("|", text(char_code_sum(F.col("path")) % 100), text(F.col("zoom")), text(x), text(y))
    plain = F.when(F.length(plain) < 16, F.rpad(plain, 16, "*")).otherwise(plain)
    zero = F.unhex(F.lit("00" * 16))
    coded = F.aes_encrypt(plain.cast("binary"), F.lit(key).cast("binary"), F.lit("CBC"), F.lit("PKCS"), zero)
    return F.concat(F.col("origin"), F.lower(F.hex(F.substring(coded, 17, 16))))


def hmac_sha1(key: bytes, message: Column) -> Column:
    """The HMAC-SHA1 of a text or binary column, as 20 bytes: two hashes over blocks that the key pads."""
    block = (hashlib.sha1(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(c ^ pad for c in block)) for pad in (0x36, 0x5C))
    return F.unhex(F.sha1(F.concat(outer, F.unhex(F.sha1(F.concat(inner, message.cast("binary")))))))


def signed_path(key: bytes):
    """(path, token, x, y, zoom) -> the path of a tile signed by HMAC-SHA1. The caller supplies the key."""

    def sign(path: Column, token: Column, x: Column | str, y: Column | str, zoom: Column | str) -> Column:
        places = [text(F.col(c) if isinstance(c, str) else c) for c in (x, y, zoom)]
        head = F.concat(path, F.lit("=x"), places[0], F.lit("-y"), places[1], F.lit("-z"), places[2], F.lit("-t"))
        mac = F.base64(hmac_sha1(key, F.concat(head, F.coalesce(token, F.lit("")))))
        return F.concat(head, F.regexp_replace(F.translate(mac, "+/", "__"), "=", ""))

    return sign


def arts_culture(key: bytes) -> Column:
    """The signed path of a tile on the metadata's host; token is what the page names, and may be null."""
    path = F.regexp_extract(F.col("origin"), r"^https?://[^/]+/(.*?)(?:=g)?\z", 1)
    return F.concat(F.lit("/"), signed_path(key)(path, F.col("token"), "x", "y", "zoom"))


def decrypted_tile(raw: Column, key: Column, iv: Column) -> Column:
    """The body of a tile whose AES-CBC part lies between a clear head and tail, where the marker 0A0A0A0A leads it.

    A four-byte little-endian length of the clear head ends the tile; before it stands the length of the coded part.
    """
    size = F.octet_length(raw)
    little = lambda at: sum((F.conv(F.hex(F.substring(raw, at + k, F.lit(1))), 16, 10).cast("bigint") * (256**k) for k in range(1, 4)), F.conv(F.hex(F.substring(raw, at, F.lit(1))), 16, 10).cast("bigint"))
    head = little(size - 3).cast("int")
    coded = little(head + 5).cast("int")
    body = F.aes_decrypt(F.concat(iv, F.substring(raw, head + 9, coded)), key, F.lit("CBC"), F.lit("PKCS"))
    clear = F.concat(F.substring(raw, F.lit(5), head), body, F.substring(raw, head + 9 + coded, size - 4 - (head + 8 + coded)))
    return F.when(F.substring(raw, F.lit(1), F.lit(4)) == F.unhex(F.lit("0A0A0A0A")), clear).otherwise(raw)


BUILDERS: dict[str, Callable[[], Column]] = {
    "Zoomify": zoomify, "Seadragon": deep_zoom, "IIPImage": iip, "Zoomify PFF": pff, "XLimage": xlimage, "TopViewer": topviewer, "krpano": krpano, "IIIF": iiif, "FSI": fsi,
    "LizardTech": lizardtech, "VLS": vls, "Micrio": from_map, "Generic": generic, "Mnesys": mnesys, "WMTS": wmts, "pnav": pnav,
}


#: Formats whose tile URLs take a key, which the caller supplies.
KEYED: dict[str, Callable[..., Column]] = {"Arts & Culture": arts_culture, "Hungaricana": hungaricana}


def register_format(name: str, builder: Callable[[], Column]) -> None:
    """Adds a format's tile URLs, or replaces them; the builder reads the columns of a planned tile. See operators.formats for whole formats."""
    BUILDERS[name] = builder


def with_origin_parts(images: DataFrame) -> DataFrame:
    """Adds origin_parts to descriptors: what links are resolved against, so that an origin is split once an image and not for each tile."""
    root, folder = link_base(F.col("origin"))
    return images.withColumn("origin_parts", F.struct(root.alias("root"), folder.alias("folder")))


def with_tile_urls(tiles: DataFrame, formats: list[str] | None = None, resolve: bool = True, keys: dict | None = None, builders: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """Adds `url` to planned tiles by their `format`, resolved against `origin` where that is set.

    formats limits the expression to those whose columns the tiles have. with_template_parts() and with_origin_parts() before
    the tiles are planned save work for formats with templates and for links. keys has the keys of KEYED formats by name; without one their URLs are
    null. builders may add to BUILDERS, or replace some.
    """
    url, builders, keys = F.lit(None).cast("string"), BUILDERS | (builders or {}), keys or {}
    for name in formats or builders:
        if name in KEYED and name not in builders:
            if name not in keys:
                continue
            own = KEYED[name](keys[name])
        else:
            own = builders[name](F.col("template_parts")) if name in TEMPLATES and "template_parts" in tiles.columns else builders[name]()
        url = F.when(F.col("format") == name, own).otherwise(url)
    known = (F.col("origin_parts.root"), F.col("origin_parts.folder")) if "origin_parts" in tiles.columns else None
    return tiles.withColumn("url", F.when(F.col("origin").isNotNull(), resolve_relative(url, F.col("origin"), known)).otherwise(url) if resolve else url)
