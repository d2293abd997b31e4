"""Text and number functions of the tile formats, as Column expressions.

Web viewers read numbers, resolve links and print doubles as browsers do; these expressions give the same answers
inside the JVM, without a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CANVAS_AREA = 16384 * 16384
EARTH_RADIUS = 6378137.0


def parse_int(text: Column) -> Column:
    """The leading integer of a text, or null."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def parse_float(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def to_int32(text: Column) -> Column:
    """A number from a whole text, 0 for anything else."""
    return F.coalesce(F.trim(text).try_cast("double").try_cast("int"), F.lit(0))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null where nothing matches; null groups of a match are empty texts."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def unset(value: Column, default) -> Column:
    """`default` for null and for 0, which stands for missing in viewers' metadata."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit(0)), default)


def decode_entities(text: Column) -> Column:
    """Decodes &amp; &lt; &gt; &quot; and numeric entities in one pass; code points wrap to 16 bits."""
    pattern = r"(?i)&(?:amp|lt|gt|quot|#(?:x[\da-f]+|\d+));"
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.lower)
    gaps = F.split(text, pattern, -1)

    def one(e: Column) -> Column:
        digits = F.regexp_extract(e, r"^&#x?([\da-f]+);$", 1)
        number = F.when(e.startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("decimal(20,0)")
        raw = F.lpad(F.hex((number % 65536).cast("bigint")), 4, "0")
        named = F.when(e == "&amp;", "&").when(e == "&lt;", "<").when(e == "&gt;", ">").when(e == "&quot;", '"')
        return F.coalesce(named, F.decode(F.unhex(raw), "UTF-16BE"))

    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.zip_with(gaps, F.concat(F.transform(found, one), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))


def link_base(base: Column) -> tuple[Column, Column]:
    """The root of a page's site and the page's folder without its slash."""
    return F.coalesce(first_match(base, r"((?:\w*://)?[^/]*/)"), base), F.regexp_replace(base, r"/[^/]*\z", "")


def resolve_relative(path: Column, base: Column, known: tuple[Column, Column] | None = None) -> Column:
    """An absolute URL for a link on the page `base`.

    A link with a scheme anywhere is kept; // takes the page's scheme; each leading ../ drops a segment more than a plain
    name does; / goes to the root; ./ is kept as it stands. known is link_base() of the page where many links share it.
    """
    ups = F.length(F.regexp_extract(path, r"^((?:\.\./)*)", 1)) / F.lit(3)
    rest = F.regexp_replace(path, r"^(?:\.\./)+", "")
    # The last `ups` segments go one by one; a base without a further slash stays.
    higher = F.aggregate(F.sequence(F.lit(1), ups.cast("int")), base, lambda acc, k: F.regexp_replace(acc, r"/[^/]*\z", ""))
    scheme = F.coalesce(first_match(base, r"(\w+:)"), F.lit("http:"))
    root, folder = known or link_base(base)
    upper_root, upper_folder = link_base(higher)
    return (
        F.when(path.contains("://"), path)
        .when(path.startswith("//"), F.concat(scheme, path))
        .when(path.startswith("../") & rest.startswith("/"), F.concat(upper_root, F.substring(rest, 2, 1 << 30)))
        .when(path.startswith("../"), F.concat(upper_folder, F.lit("/"), rest))
        .when(path.startswith("/"), F.concat(root, F.substring(path, 2, 1 << 30)))
        .otherwise(F.concat(folder, F.lit("/"), path))
    )


def encode_uri_component(text: Column) -> Column:
    """Percent-encodes all but letters, digits and -_.!~*'()."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for raw, coded in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(coded), F.lit(raw))
    return out


def encode_uri(text: Column) -> Column:
    """Percent-encodes what may not stand in a URL, leaving its reserved signs."""
    out = encode_uri_component(text)
    for raw in ";,/?:@&=+$#":
        out = F.replace(out, F.lit(f"%{ord(raw):02X}"), F.lit(raw))
    return out


def request_url(url: Column) -> Column:
    """A URL as it is fetched: encoded, unless it already holds an escape."""
    return F.when(url.rlike("%[a-zA-Z0-9]{2}"), url).otherwise(encode_uri(url))


def pad_left(text: Column, width: Column | int, sign: Column | str) -> Column:
    """Pads without ever cutting."""
    width = width if isinstance(width, Column) else F.lit(width)
    sign = sign if isinstance(sign, Column) else F.lit(sign)
    return F.concat(F.repeat(sign, F.greatest(width - F.length(text), F.lit(0))), text)


def js_number(x: Column) -> Column:
    """A double as browsers print it: no .0, an exponent only below 1e-6 and from 1e21."""
    shortest = x.cast("string")
    mantissa, exponent = F.regexp_extract(shortest, r"^(-?[\d.]+)E", 1), F.regexp_extract(shortest, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0\z", ""), r"[-.]", "")
    point = F.length(F.regexp_extract(F.regexp_replace(mantissa, "^-", ""), r"^(\d+)", 1)) + exponent
    sign = F.when(x < 0, "-").otherwise("")
    tail = F.regexp_replace(digits, r"0+\z", "")
    moved = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), tail)).when(point >= F.length(tail), F.concat(tail, F.repeat(F.lit("0"), point - F.length(tail)))).otherwise(F.concat(F.left(tail, point), F.lit("."), F.substring(tail, point + 1, F.length(tail))))
    scientific = F.concat(sign, F.regexp_replace(F.regexp_replace(F.regexp_replace(mantissa, "^-", ""), r"\.0\z", ""), "^$", "0"), F.when(exponent < 0, "e").otherwise("e+"), exponent.cast("string"))
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return (
        F.when(whole, x.cast("bigint").cast("string"))
        .when(~shortest.contains("E"), F.regexp_replace(shortest, r"\.0\z", ""))
        .when((F.abs(x) < 1e-6) | (F.abs(x) >= 1e21), scientific)
        .otherwise(F.concat(sign, moved))
    )


def char_code_sum(text: Column) -> Column:
    """The sum of the UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda acc, c: acc + F.conv(c, 16, 10).cast("bigint"))


def is_private_ipv4(host: Column) -> Column:
    parts = [F.coalesce(F.regexp_extract(host, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$", k).try_cast("int"), F.lit(-1)) for k in (1, 2)]
    return (parts[0] == 10) | ((parts[0] == 172) & parts[1].between(16, 31)) | ((parts[0] == 192) & (parts[1] == 168))


def find_max_zoom(width: Column, height: Column, tile: Column, factor: Column | float = 2.0, base: Column | int = 0) -> Column:
    """The zoom at which the whole image is at full size; negative if it is at most half a tile."""
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    base = base if isinstance(base, Column) else F.lit(base)
    return (F.ceil(F.log(F.greatest(width, height).cast("double") / tile) / F.log(factor.cast("double"))) + base).cast("int")


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres."""
    half = F.lit(EARTH_RADIUS) * F.pi()
    return half * lon / 180.0, F.lit(EARTH_RADIUS) * F.log(F.tan(F.pi() * (lat + 90.0) / 360.0))
