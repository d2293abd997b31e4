"""From a page to the URL of its metadata document: rewrites of the URL, what the page says, and further documents.

The patterns here, as in detect.RULES, are fixed values: what pages and URLs of each format say.

Each format gives three columns: direct (from the URL alone), hop (a document to read first) and found (from the page or
that document). A document that isn't in the crawl leaves needs_url for the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import decode_entities, encode_uri_component, first_match, parse_int, resolve_relative
from tessera.operators import detect as d
from tessera.operators.closure import bodies, closure
from tessera.sources.shared import Written, meet, shuffled


#: A name of a document from the start of a text on, as long as it gets.
NAMED = r"(?is)^(.+\.(?:xml|dzi))"


@dataclass
class Discovery:
    """direct: the metadata URL, if the URL tells it. hop: another document's URL. found: by page or hop_body. error: if none.

    other: what takes the place of direct where only that is in the crawl. follow: a page to look at instead of this one.
    token: what the page has for signing tile URLs.
    """

    direct: Column | None = None
    hop: Column | None = None
    found: Column | None = None
    error: str = "No metadata URL was found."
    other: Column | None = None
    follow: Column | None = None
    token: Column | None = None


def _let(value: Column, f) -> Column:
    """f(value), which stands once in the plan however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _resolved(path: Column, base: Column) -> Column:
    return _let(F.struct(path.alias("path"), base.alias("base")), lambda x: resolve_relative(x["path"], x["base"]))


def _properties(path: Column) -> Column:
    return _let(path, lambda p: F.concat(p, F.when(p.endswith("/"), "ImageProperties.xml").otherwise("/ImageProperties.xml")))


def zoomify() -> Discovery:
    url, page, hop_body = F.col("url"), F.col("page"), F.col("hop_body")
    base = F.coalesce(_resolved(first_match(page, r"(?i)<base\s+[^>]*href\s*=\s*[\"']([^\"']*)"), url), url)
    pattern = r"zoomifyImagePath=([^'\"&]*)['\"&]|showImage\([^),]*,\s*[\"']([^'\"]*)"
    found = F.regexp_extract_all(page, F.lit(f"({pattern})"), F.lit(1))
    paths = F.filter(F.transform(found, lambda m: F.coalesce(F.nullif(F.regexp_extract(m, pattern, 1), F.lit("")), F.regexp_extract(m, pattern, 2))), lambda p: p != "")
    service = first_match(page, r"(?s)type['\"]?\s*:\s*['\"]zoomifytileservice.*tilesUrl[\"']?\s*:\s*[\"']([^'\"]+)")
    first = _resolved(F.coalesce(F.get(F.array_distinct(paths), 0), service), base)
    access = first_match(page, r"(?i)accessnumber=([^\"&\s']+)")
    broker = _resolved(F.concat(F.lit("/scripts/XMLBroker.new.php?Lang=2&contentType=IMAGES&contentID="), access), url)
    frame = _resolved(first_match(page, r"<iframe[^>]*src=[\"']([^\"']*)"), url)
    library = F.when(url.contains("biblio.unibe.ch/web-apps/maps/zoomify.php"), _resolved(first_match(page, r"url = '([^']*)'"), url))
    layers = first_match(page, r"<[^>]*class=\"ete-openlayers-src\"[^>]*>(.*?)</.*>")
    gallery = F.when(url.contains("ngv.vic.gov.au"), first_match(page, r"var url = '(.*?)'"))
    near = F.coalesce(library, layers, gallery)
    of_hop = F.nullif(F.xpath_string(F.when(first.isNull() & access.isNotNull(), hop_body), F.lit("(//imagefile[@format='zoomify'])[1]")), F.lit(""))
    fallback = F.when(page.isNotNull(), F.coalesce(first_match(page, r"<url>(.*)</url>"), url))
    tile = first_match(url, r"^(.*)/TileGroup\d+/\d+-\d+-\d+.jpg\z")
    return Discovery(
        direct=F.when(url.rlike(r"ImageProperties\.xml(\?.*)?\z"), url).otherwise(_properties(tile)),
        hop=F.when(first.isNull(), broker),
        found=_properties(F.coalesce(first, of_hop, F.when(broker.isNull(), F.coalesce(near, F.when(frame.isNull(), fallback))))),
        follow=F.when(first.isNull() & broker.isNull() & near.isNull(), frame),
    )


def seadragon() -> Discovery:
    """Of a tile's two possible documents the .dzi comes first, the .xml where only that is in the crawl."""
    url, page, hop_body = F.col("url"), F.col("page"), F.col("hop_body")
    paris = r"bibliotheques-specialisees.paris.fr/ark:((?:/\w+){3})(.*)"
    reader = F.when(url.rlike(paris), F.concat(F.lit("https://bibliotheques-specialisees.paris.fr/in/imageReader.xhtml?id=ark:"), F.regexp_extract(url, paris, 1), F.lit("&updateUrl=updateUrl1653&ark="), F.regexp_extract(url, paris, 1), F.regexp_extract(url, paris, 2), F.lit("&selectedTab=otherdocs")))
    polona = r"polona.pl/item/(\d+)/(\d+)"
    item = F.when(url.rlike(polona), F.concat(F.lit("http://polona.pl/resources/item/"), F.regexp_extract(url, polona, 1), F.lit("/?format=json")))
    pages = F.from_json(F.when(url.rlike(polona), hop_body), "pages array<struct<dzi_url:string>>")["pages"]
    template = F.when(url.rlike(r"view/\d+/\d+") & page.contains("dziUrlTemplate"), first_match(page, r"(?i)\"([^\"]+\.dzi)\""))
    number = lambda k: F.regexp_extract(url, r"view/0*(\d+)/0*(\d+)", k)
    by_number = F.replace(F.replace(template, F.lit("{group}"), number(1)), F.lit("{index}"), number(2))
    text = F.when(page.isNotNull() & item.isNull(), F.coalesce(F.when(reader.isNotNull(), hop_body), page))
    low = F.lower(text)
    tag = F.when(low.contains("img_cache") & text.rlike(r"(?is)<img\b(?=[^>]*\bimg_cache\b)(?=[^>]*\bdata-pyr=)(?=[^>]*\bdata-width=)(?=[^>]*\bdata-height=)[^>]*>"), url)
    # What stands in the call's brackets, and its last quoted document; then the first run without quotes or brackets that
    # names one. Both are found by cutting first, as one pattern for the whole takes time with the square of a page.
    closed = F.when(low.contains("seadragon.embed("), F.split(text, r"\)"))
    calls = F.transform(F.filter(F.slice(closed, 1, F.size(closed) - 1), lambda c: F.lower(c).contains("seadragon.embed(")), lambda c: F.regexp_extract(c, r"(?is)Seadragon\.embed\((.*)\z", 1))
    quoted = r"(?is)^.*[\"']([^\"']+\.(?:xml|dzi)(?:\?[^\"']*)?)[\"']"
    embed = _let(F.get(F.filter(calls, lambda c: c.rlike(quoted)), 0), lambda c: first_match(c, quoted))
    runs = F.when(low.contains(".xml") | low.contains(".dzi"), F.split(text, r"[\"'()<>]"))
    anything = _let(F.get(F.filter(runs, lambda r: r.rlike(NAMED)), 0), lambda r: first_match(r, NAMED))
    link = F.when(low.contains("dzi"), first_match(text, r"(?i)[^a-z]dzi[\"'<>\s:=]+([^<\"']*)"))
    tile = first_match(url, r"^(.*)_files/\d+/\d+_\d+.jpg\z")
    return Discovery(
        other=F.when(~url.rlike(r"(?i)\.xml|\.dzi"), F.concat(tile, F.lit(".xml"))),
        direct=F.when(url.rlike(r"(?i)\.xml|\.dzi"), url)
        .when(url.contains("bl.uk/manuscripts/Viewer.aspx"), F.regexp_replace(F.replace(url, F.lit("Viewer.aspx"), F.lit("Proxy.ashx")), "ref=([^&]*)", "view=$1.xml"))
        .when(url.rlike(r"nla\.gov\.au/nla\.obj.*/view\z"), F.regexp_replace(url, r"view/?\z", "dzi"))
        .otherwise(F.concat(tile, F.lit(".dzi"))),
        hop=F.coalesce(reader, item),
        found=F.coalesce(F.get(pages, F.regexp_extract(url, polona, 2).try_cast("int"))["dzi_url"], by_number, tag, embed, anything, link, F.when(text.isNotNull(), url)),
    )


def iipimage() -> Discovery:
    url, page = F.col("url"), F.col("page")
    return Discovery(direct=F.when(url.contains("?FIF="), url), found=_resolved(first_match(page, r"[\"']([^\"']*?\?FIF=.*?)[\"']"), url), error="No IIPImage-related URL found.")


def zoomify_pff() -> Discovery:
    url, page = F.col("url"), F.col("page")
    value = lambda k: first_match(page, rf"{k}=([^'\"&]*)['\"&]")
    built = F.concat(F.lit("http://"), value("zoomifyServerIP"), value("zoomifyTileHandlerPath"), F.lit("?file="), value("zoomifyImagePath"))
    return Discovery(direct=F.when(url.rlike(r"file=.*&requestType="), F.regexp_replace(url, r"&(begin|end|head|requestType)=\d+", "")), found=built)


def xlimage() -> Discovery:
    """The site's viewer needs a page number: the column page_number, counted from 0, or 0."""
    url = F.col("url")
    viewer = r"kbr.be/multi/([\w\d-]+)Viewer"
    name, number = F.regexp_extract(url, viewer, 1), F.right(F.concat(F.lit("000"), (F.coalesce(F.col("page_number"), F.lit(0)) + 1).cast("string")), F.lit(3))
    return Discovery(direct=F.when(url.rlike(viewer), F.concat(F.lit("/multi/"), name, F.lit("Viewer/xml.php?/multi/"), name, F.lit("/"), number, F.lit(".imgi?cmd=info"))).otherwise(url))


def topviewer() -> Discovery:
    url, page = F.col("url"), F.col("page")
    server, image = first_match(page, d.MEMORIX, 1), first_match(page, d.MEMORIX, 2)
    by_thumb = F.when(server == "rkd", F.concat(F.lit("https://images.rkd.nl/rkd/topviewjson/memorix/"), image)).otherwise(F.concat(F.lit("http://images.memorix.nl/"), server, F.lit("/topviewjson/memorix/"), image))
    quoted = first_match(page, r"[\"']?server[\"']?\s*:\s*[\"']([^\"']+)[\"']")
    named_server = _resolved(F.from_json(F.concat(F.lit('{"u":"'), quoted, F.lit('"}')), "u string")["u"], url)
    return Discovery(direct=F.when(url.rlike(r"memorix\.nl/.+/topviewjson/memorix"), url), found=F.coalesce(by_thumb, named_server, F.when(page.isNotNull(), url)))


def krpano() -> Discovery:
    url, page = F.col("url"), F.col("page")
    return Discovery(found=F.coalesce(first_match(page, r"(?s)embedpano\(\s*\{.*xml.?\s*:\s*\\?[\"']([^\"'\\]*)"), F.when(page.isNotNull(), url)))


def info_url(text: Column, base: Column | None = None) -> Column:
    """The info.json of the first image API URL in a text: absolute, then relative, then a bare root, then a custom element."""
    # The patterns begin at any slash, of which coded images have many, so what they must end in is looked for first.
    ends = text.rlike(r"/info\.json|/(?:color|gray|bitonal|default|native)\.")
    api = F.coalesce(F.when(ends, F.coalesce(first_match(text, d.ABSOLUTE_API), first_match(text, d.RELATIVE_API))), F.when(text.contains(".ptif"), first_match(text, d.LONDON)))
    out = F.coalesce(F.concat(api, F.lit("/info.json")), F.concat(F.lit("https://i.micr.io/"), first_match(text, d.MICRIO_TAG), F.lit("/info.json")))
    out = out if base is None else _resolved(out, base)
    return F.regexp_replace(out, r"micrio\.vangoghmuseum\.nl/iiif", "micrio-cdn.vangoghmuseum.nl")


def short_id(text: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(text, d.PHILADELPHIA, 1), F.lit("")), F.nullif(F.regexp_extract(text, d.PHILADELPHIA, 2), F.lit("")))
    return F.concat(F.lit("https://i.micr.io/"), found, F.lit("/info.json"))


def contentdm_info(uri: Column, origin: Column, app: Column) -> Column:
    return F.when(uri.rlike(r"\w*://"), uri).when(uri.startswith(F.concat(app, F.lit("/"))), F.concat(origin, uri)).when(uri.startswith("/"), F.concat(origin, app, uri)).otherwise(F.concat(origin, app, F.lit("/"), uri))


def manifest_parameter(link: Column) -> Column:
    """The manifest named in the query, else in the fragment, decoded."""
    value = lambda text: F.nullif(F.regexp_extract(text, r"(?:^|[?&])manifest=([^&]*)", 1), F.lit(""))
    query, fragment = F.regexp_extract(link, r"^[^#?]*(\?[^#]*)", 1), F.regexp_replace(F.regexp_extract(link, r"#(.*)\z", 1), r"^\?", "")
    return F.try_url_decode(F.coalesce(value(query), value(fragment)))


def national_manifest(link: Column) -> Column:
    prefix = F.lit("https://api.onb.ac.at/iiif/presentation/v3/manifest/")
    viewer = F.nullif(F.regexp_extract(link, r"^https?://viewer\.onb\.ac\.at/+([^/?#]+)", 1), F.lit(""))
    document = F.try_url_decode(F.nullif(F.regexp_extract(link, r"^https?://digital\.onb\.ac\.at/RepViewer/viewer\.faces\?(?:[^#]*&)?doc=([^&#]+)", 1), F.lit("")))
    return F.when(link.rlike(d.ONB[0]), link).otherwise(F.concat(prefix, F.coalesce(viewer, encode_uri_component(document))))


def _service_url(service: Column) -> Column:
    """The info.json of a service, given as a JSON text, if it is an image API service."""
    get = lambda k: F.get_json_object(service, f"$['{k}']")
    link = F.coalesce(F.nullif(get("@id"), F.lit("")), get("id"))
    kind = F.coalesce(F.nullif(get("type"), F.lit("")), get("@type"), F.lit(""))
    image = kind.rlike(r"^ImageService[0-9]?\z") | F.coalesce(get("profile"), F.lit("")).contains("iiif.io/api/image/") | F.coalesce(get("@context"), F.lit("")).contains("iiif.io/api/image/")
    return F.when(image & link.isNotNull(), F.when(link.rlike(r"/info\.json(?:[?#].*)?\z"), link).otherwise(F.regexp_replace(link, r"^(.*?)/?([?#].*)?\z", "$1/info.json$2")))


def _several(text: Column) -> Column:
    """A JSON array's elements as texts; anything else as the only one."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))


def manifest_service(text: Column) -> Column:
    """The first image service of a presentation manifest, version 2 before version 3, depth first."""
    two = F.from_json(text, "sequences array<struct<canvases:array<struct<images:array<struct<resource:struct<service:string>>>>>>>")["sequences"]
    three = F.from_json(text, "items array<struct<items:array<struct<items:array<struct<body:string>>>>>>")["items"]
    none = F.array().cast("array<string>")
    of = lambda rows, f: F.flatten(F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.coalesce(f(r), none)))
    services = of(two, lambda s: of(s["canvases"], lambda c: of(c["images"], lambda i: _several(i["resource"]["service"]))))
    bodies = of(three, lambda p: of(p["items"], lambda a: of(a["items"], lambda n: _several(n["body"]))))
    inner = F.flatten(F.transform(bodies, lambda b: _several(F.get_json_object(b, "$.service"))))
    first = lambda rows: F.get(F.filter(F.transform(rows, _service_url), lambda u: u.isNotNull()), 0)
    return F.coalesce(first(services), first(inner))


def iiif() -> Discovery:
    url, page, hop_body = F.col("url"), F.col("page"), F.col("hop_body")
    ark = F.concat(F.lit("https://gallica.bnf.fr/iiif/ark:/"), first_match(url, d.GALLICA, 1), F.lit("/"), F.coalesce(F.nullif(F.regexp_extract(url, d.GALLICA, 2), F.lit("")), F.lit("f1")), F.lit("/info.json"))
    part = lambda k: first_match(url, d.CONTENTDM, k)
    record = F.concat(part(1), part(2), F.lit("/api/singleitem/collection/"), part(3), F.lit("/id/"), part(4))
    manifest = F.coalesce(national_manifest(url), F.when(url.rlike(d.MANIFEST), manifest_parameter(url)))
    of_record = F.when(record.isNotNull(), contentdm_info(F.get_json_object(hop_body, "$.iiifInfoUri"), part(1), part(2)))
    of_manifest = F.when(record.isNull() & manifest.isNotNull(), manifest_service(hop_body))
    of_page = F.when(record.isNull() & manifest.isNull(), F.coalesce(info_url(page, url), short_id(page)))
    return Discovery(direct=F.coalesce(ark, info_url(url)), hop=F.coalesce(record, manifest), found=F.coalesce(of_record, of_manifest, of_page), error="No IIIF Image API service found.")


def fsi() -> Discovery:
    url, page = F.col("url"), F.col("page")
    asks = r"server.*[?&]source=([^&]+)"
    info = lambda u: F.when(u.rlike(asks), F.regexp_replace(u, r"server\?.*\z", F.concat(F.lit("server?type=info&source="), F.regexp_replace(F.regexp_extract(u, asks, 1), r"([\\$])", r"\\$1"))))
    tokens = F.filter(F.regexp_extract_all(page, F.lit(r"([^\s\"']*/server[^\s\"']*)"), F.lit(1)), lambda t: t.rlike(asks))
    return Discovery(direct=info(url), found=info(F.get(tokens, 0)), error="No FSI URL found.")


def vls() -> Discovery:
    url = F.col("url")
    return Discovery(direct=F.regexp_replace(url, r"^(.*?)/(?:thumbview|pageview|zoom)/", "$1/zoom/"))


def micrio() -> Discovery:
    url, page, hop_body = F.col("url"), F.col("page"), F.col("hop_body")
    own = F.concat(first_match(page, r"data-base-path=\"([^\"]+)\""), first_match(page, r"data-id=\"([^\"]+)\""))
    source, query = first_match(page, r"dataSourcePath[\"']?\s*:\s*[\"']([^'\"]*)['\"]"), first_match(page, r"dataSourceQuery[\"']?\s*:\s*\"([^\"]*)\"")
    wanted = r"#/([^,]*)(?:,(\d+))?"
    offset = F.nullif(F.regexp_extract(url, wanted, 2), F.lit(""))
    path = F.concat(source, F.coalesce(query, F.lit("")))
    path = F.when(offset.isNotNull(), F.regexp_replace(path, r"^(.*?)offset=\d+", F.concat(F.lit("$1offset="), offset))).otherwise(path)
    items = F.from_json(hop_body, "setItems array<struct<ObjectNumber:string,TilingUrl:string>>")["setItems"]
    chosen = F.coalesce(F.get(F.filter(items, lambda i: i["ObjectNumber"] == F.regexp_extract(url, wanted, 1)), 0), F.get(items, 0))
    return Discovery(direct=F.when(url.rlike(r"/api/getTilesInfo\?object_id="), url), hop=F.when(own.isNull(), _resolved(path, url)), found=F.coalesce(own, chosen["TilingUrl"], F.when(page.isNotNull() & source.isNull(), url)))


def arts_culture() -> Discovery:
    page = F.col("page")
    named = r"]\n?,\"(//[a-zA-Z0-9./_\-]+)\",(?:\"([^\"]+)\"|null)"
    found = F.concat(F.lit("https:"), first_match(page, named), F.lit("=g"))
    return Discovery(found=found, token=F.nullif(F.regexp_extract(page, named, 2), F.lit("")), error="No metadata URL of the image was found.")


def hungaricana() -> Discovery:
    url, page, hop_body = F.col("url"), F.col("page"), F.col("hop_body")
    layer = F.concat(first_match(page, r"layer_?[uU]rl[\"']?\s*:\s*['\"]([^'\"]*)"), F.coalesce(first_match(page, r"\Wpath[\"']?\s*:\s*[\"']([^\"']*)"), F.lit("")))
    place = F.coalesce(F.regexp_extract(url, r"(?:img|pg)=(\d+)", 1).try_cast("int"), F.lit(0))
    one = first_match(page, r"imagepath[\"']?\s*=\s*[\"']([^\"']*)")
    listed = first_match(page, r"(?:files|images)[\"']?\s*:\s*(\[.*?\])")
    other = first_match(page, r"files_url[\"']?\s*:\s*['\"]([^'\"]*)")
    names = F.from_json(F.coalesce(listed, hop_body), "array<string>")
    return Discovery(direct=F.when(url.endswith(".ecw"), url), hop=F.when(one.isNull() & listed.isNull(), other), found=F.concat(layer, F.coalesce(one, F.get(names, place))), error="Unable to find the layer file name")


def mnesys() -> Discovery:
    """The playlist is the URL itself or named in the page; only the first dot of a page's name becomes an underscore."""
    url, page, hop_body = F.col("url"), F.col("page"), F.col("hop_body")
    text = first_match(page, r"flashVars[\"= ,]+\"([^\"]+)\"")
    value = lambda k: F.nullif(F.regexp_extract(text, rf"(?:^|&){k}=([^&]*)", 1), F.lit(""))
    listed = url.rlike(r"/playlists/.*\.xml(\?.*)?\z")
    number = F.coalesce(F.when(~listed, parse_int(value("cur_item"))), F.regexp_extract(url, r"img_num=(\d+)", 1).try_cast("bigint"), F.lit(0)).cast("int")
    playlist = F.when(listed, page).otherwise(hop_body)
    name = F.get(F.xpath(playlist, F.lit("(//playlist)[1]//a/text()")), number)
    base = F.concat(F.xpath_string(playlist, F.lit("(//playlist)[1]/@host")), F.xpath_string(playlist, F.lit("(//playlist)[1]/@basepath")))
    return Discovery(direct=F.when(url.rlike(r"/p\.xml(\?.*)?\z"), url), hop=F.when(~listed, _resolved(value("playlist"), url)), found=F.concat(base, F.regexp_replace(name, r"^([^.]*)\.", "$1_"), F.lit("_/p.xml")), error="Invalid mnesys playlist")


def itself() -> Discovery:
    url = F.col("url")
    return Discovery(direct=url)


DISCOVERIES = {
    "Zoomify": zoomify, "Seadragon": seadragon, "IIPImage": iipimage, "Zoomify PFF": zoomify_pff, "XLimage": xlimage, "TopViewer": topviewer, "krpano": krpano, "IIIF": iiif, "FSI": fsi,
    "LizardTech": itself, "VLS": vls, "Micrio": micrio, "Generic": itself, "Arts & Culture": arts_culture, "Hungaricana": hungaricana, "Mnesys": mnesys, "WMTS": itself, "pnav": itself,
}


def discover(requests: DataFrame, documents: DataFrame, formats: list[str] | None = None, discoveries: dict | None = None) -> DataFrame:
    """Adds meta_url, token, needs_url and error to requests (request_id, url, format[, page_number]), by documents (url, body).

    Each row is in the result once, whatever its format: rows of a format that has no rules, or of none, are errors. Equal
    requests are looked at once. Those whose URL tells the metadata URL are joined with nothing; the others meet their page,
    and those that need a second document meet that: two equi-joins for all formats together. Pages that only lead to
    another page, by a frame, start a walk to the one that doesn't, which is then looked at in their place. Of documents that repeat a URL the least body counts. formats are those with rules; by default all of those
    that the requests name, as each costs time in planning. discoveries are those of another registry than the built-in one.
    """
    tables, known = Written(requests.sparkSession, "discover"), DISCOVERIES if discoveries is None else discoveries
    if "page_number" not in requests.columns:
        requests = requests.withColumn("page_number", F.lit(None).cast("int"))
    requests = requests.select("request_id", "url", "format", "page_number")
    asked = tables.put(requests.select("url", "format", "page_number").distinct(), "asked")
    if formats is None:
        formats = [r.format for r in asked.select("format").distinct().collect() if r.format in known]
    ask = ["start", "format", "page_number"]
    rows = asked.select(F.col("url").alias("start"), "url", "format", "page_number")
    told = tables.put(_step(rows, documents, {n: known[n]() for n in formats}), "step")
    facts, again = told.filter("follow is null"), told.filter("follow is not null")
    if not again.isEmpty():
        # Walks over pages that lead on end at one that doesn't, or at one that isn't in the crawl; that one is looked at.
        again = again.select(*ask, "follow")
        leading = {n: how for n in formats if (how := known[n]()).follow is not None}
        walks = closure(again.select(F.col("format").alias("kind"), F.col("follow").alias("start")), documents, _follows(leading))
        ends = walks.select(F.col("kind").alias("format"), F.col("start").alias("follow"), F.coalesce("found_url", "needs_url").alias("url"))
        ended = tables.put(again.join(shuffled(ends), ["format", "follow"]).select("start", "url", "format", "page_number"), "ended")
        last = tables.put(_step(ended.filter("url is not null"), documents, leading), "last")
        round_ = ended.filter("url is null").select(*ask, F.lit("Frames lead back to a page that was seen.").alias("error"))
        facts = facts.unionByName(last).unionByName(round_, allowMissingColumns=True)
    facts = facts.select(*ask, "meta_url", "token", "needs_url", "error")
    # Nulls are equal here: the key is a text of all three.
    key = lambda url: F.to_json(F.struct(F.col(url).alias("u"), F.col("format").alias("f"), F.col("page_number").alias("p")))
    facts = facts.withColumn("ask", key("start")).drop(*ask)
    return meet(requests.withColumn("ask", key("url")), facts, ["ask"], ["request_id"]).select("request_id", "url", "format", "meta_url", "token", "needs_url", "error")


def _left(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows (start, ...) with what facts (url, ...) have for the URL in the column `key`.

    Most rows may have none: each then has a key of its own, that no URL is, as rows of a null key would all go to one task.
    """
    own = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col("start"), F.lit("\0"), F.coalesce("page_number", F.lit(0)).cast("string")))
    return rows.withColumn("__key", own).join(shuffled(facts.withColumnRenamed("url", "__key")), "__key", "left").drop("__key")


def _follows(rules: dict[str, Discovery]):
    """read() of closure() for pages of formats that lead on: done is a page that doesn't."""
    next_ = F.lit(None).cast("string")
    for name, how in rules.items():
        if how.follow is not None:
            next_ = F.when(F.col("kind") == name, how.follow).otherwise(next_)

    def read(pages: DataFrame) -> DataFrame:
        told = pages.withColumn("page", decode_entities(F.col("body"))).withColumn("link", next_)
        return told.select("kind", "url", F.col("link").isNull().alias("done"), F.lit(None).cast("string").alias("value"), F.array("link").alias("next"))

    return read


def _step(rows: DataFrame, documents: DataFrame, rules: dict[str, Discovery]) -> DataFrame:
    """One look at the pages of rows (start, url, format, page_number); follow is the page to look at instead."""
    url, null = F.col("url"), F.lit(None).cast("string")
    ruled = F.coalesce(F.col("format").isin(*rules), F.lit(False)) if rules else F.lit(False)

    def chosen(part: str) -> Column:
        out = null
        for name, how in rules.items():
            c = getattr(how, part)
            if c is not None:
                out = F.when(F.col("format") == name, c).otherwise(out)
        # Inside a higher-order function, as compiled code of all formats' rules in one expression grows too large.
        return F.transform(F.array(F.lit(0)), lambda _: out)[0]

    def met(rows: DataFrame, key: str, name: str) -> DataFrame:
        own = bodies(documents, rows.select(F.col(key).alias("url")))
        return _left(rows, own.select("url", F.col("body").alias(name)), key)

    rows = rows.withColumn("direct", chosen("direct"))
    if any(how.other is not None for how in rules.values()):
        rows = rows.withColumn("other", chosen("other"))
        pairs = rows.filter("other is not null")
        wanted = pairs.select(F.col("direct").alias("url")).unionByName(pairs.select(F.col("other").alias("url"))).distinct()
        held = documents.select("url").join(shuffled(wanted), "url", "left_semi").distinct()
        for name in ("direct", "other"):
            rows = _left(rows, held.select("url", F.lit(True).alias(f"{name}_held")), name)
        rows = rows.withColumn("direct", F.when(F.col("direct_held").isNull() & F.col("other_held"), F.col("other")).otherwise(F.col("direct"))).drop("direct_held", "other_held", "other")
    rows = rows.withColumn("asks", F.when(F.col("direct").isNull() & ruled, url))
    rows = met(rows, "asks", "raw").withColumn("page", decode_entities(F.col("raw"))).drop("raw").withColumn("hop", F.when(F.col("direct").isNull(), chosen("hop")))
    rows = rows.withColumn("follow", F.when(F.col("direct").isNull(), chosen("follow")))
    rows = met(rows, "hop", "hop_body").withColumn("meta_url", F.coalesce("direct", chosen("found")))
    none, no_rule = F.col("meta_url").isNull(), ~ruled
    needs = F.when(none & ~no_rule & F.col("hop").isNotNull() & F.col("hop_body").isNull(), F.col("hop")).when(none & ~no_rule & F.col("hop").isNull() & F.col("page").isNull(), url)
    errors = F.when(no_rule, "No such format.")
    for name, how in rules.items():
        errors = errors.when(F.col("format") == name, how.error)
    rows = rows.withColumn("needs_url", needs).withColumn("error", F.when(none & F.col("needs_url").isNull(), errors))
    return rows.select("start", "format", "page_number", F.when(~none, _resolved(F.col("meta_url"), F.col("start"))).alias("meta_url"), F.when(~none, chosen("token")).alias("token"), "needs_url", "error", F.when(none, F.col("follow")).alias("follow"))
