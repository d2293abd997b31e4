"""Which format serves a page: rules on the URL first, then rules on the page and its frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import decode_entities, resolve_relative
from tessera.operators.closure import closure
from tessera.operators.ruleindex import Rule, RuleIndex, guard
from tessera.sources.shared import meet

#: Fixed values, in order of priority: (format, patterns of URLs, patterns of pages).
IMAGE_API = (
    r"(?:/info\.json|/\^?(?:full|square|(?:pct:)?\d+,\d+,\d+,\d+)/(?:full|max|\d+,|,\d+|pct:\d+|!?\d+,\d+)/!?[1-3]?[0-9]?[0-9]"
    r"/(?:color|gray|bitonal|default|native)\.(?:jpe?g|tiff?|png|gif|jp2|pdf|webp))"
)
ABSOLUTE_API = r"(https?://[^\"'\s]+)" + IMAGE_API
RELATIVE_API = r"((?:/|\.\.?/)[^\"'\s<>]+)" + IMAGE_API
LONDON = r"(https?://collections\.londonmuseum\.net/iiif/3/[^\"'\s<>]+?\.ptif)(?=[\"'\s<>])"
SHORT_ID = r"\\?\"shortId\\?\"\s*:\s*\\?\"([A-Za-z0-9_-]{3,32})\\?\""
PHILADELPHIA = rf"(?s)(?:philamuseum|Philadelphia Museum).*{SHORT_ID}|{SHORT_ID}.*(?:philamuseum|Philadelphia Museum)"
MICRIO_TAG = r"(?i)<micr-io\b[^>]*\bid=[\"']([A-Za-z0-9]{5})[\"'][^>]*>"
GALLICA = r"https?://gallica\.bnf\.fr/ark:/(\w+/\w+)(?:/(f\w+))?"
CONTENTDM = r"^(https?://[^/]+)(/digital)/collection/([^/?#]+)/id/(\d+)(?:[/?#]|\z)"
MANIFEST = r"^https?://[^#]*(?:[?&][^#]*\bmanifest=|#[^#]*\bmanifest=)"
ONB = (r"^https?://api\.onb\.ac\.at/iiif/presentation/v3/manifest/[^?#]+(?:[?#].*)?\z", r"^https?://viewer\.onb\.ac\.at/[^?#]+(?:[?#].*)?\z", r"^https?://digital\.onb\.ac\.at/RepViewer/viewer\.faces\?(?=[^#]*\bdoc=)")
MEMORIX = (
    r"(?:images\.memorix|afbeeldingen\.gahetna|images\.rkd)\.nl/(.*?)/thumb/(?:image(?:bank)?-)?"
    r"(?:[0-9x]*?(?:crop)?|detailresult|gallery_thumb|mediabank-(?:detail|horizontal))/(.*?)\.jpg"
)
FSI_SERVER = r"server\?.*(?:(?:type=|image=).*?){2}"
RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("Zoomify", (r"ImageProperties\.xml(\?.*)?\z", r"/TileGroup\d+/\d+-\d+-\d+.jpg\z", r"biblio\.unibe\.ch/web-apps/maps/zoomify\.php", r"bspe-p-pub\.paris\.fr/MDBGED/zoomify-BFS\.aspx", r"ngv\.vic\.gov\.au/explore/collection/work", r"artandarchitecture\.org\.uk/images/zoom"),
     (r"zoomifyImagePath=", r"showImage\(", r"accessnumber=", r"ete-openlayers-src", r"type['\"]?\s*:\s*['\"]zoomifytileservice")),
    ("Seadragon", (r"museodelprado\.es/(?:en/the-collection|coleccion)/(?:art-work|obra-de-arte)/", r"bl\.uk/manuscripts/Viewer\.aspx", r"polona\.pl/item/", r"bibliotheques-specialisees\.paris\.fr/ark", r"nla\.gov\.au/nla\.obj.*/view\z", r"_files/\d+/\d+_\d+.jpg\z", r"dzi\z"),
     (r"(?i)data-pyr=[\"'][^\"']+[\"'][^>]*\bimg_cache\b|\bimg_cache\b[^>]*data-pyr=", r"dziUrlTemplate", r"(?i)Seadragon\.embed\([^)]*[\"'][^\"']+\.(?:xml|dzi)(?:\?[^\"']*)?[\"']", r"(?i)[^\"'()<>]\.dzi", r"schemas\.microsoft\.com/deepzoom", r"zoom(?:\.it|hub.net)/.*\.js", r"\b(dzi|DZI)\b")),
    ("IIPImage", (r"^((?!topview).)*\?FIF=.*$",), (r"\?FIF=",)),
    ("Zoomify PFF", (r"file=.*&requestType=", r"\.pff\z"), (r"zoomifyTileHandlerPath=",)),
    ("XLimage", (r"kbr.be/multi/([\w\d-]+)Viewer", r"\.img.\?cmd=info"), ()),
    ("TopViewer", (r"memorix", r"rhcrijnstreek\.nl", r"topview\.?json"), (MEMORIX, r"\"topviews\"\s*:")),
    ("krpano", (r"hyper-photo\.com/hyperpano", r"krpano\.com"), (r"embedpano\(\s*\{", r"krpano")),
    ("IIIF", (ABSOLUTE_API, GALLICA, CONTENTDM, MANIFEST, *ONB), (ABSOLUTE_API, RELATIVE_API, LONDON, PHILADELPHIA, MICRIO_TAG)),
    ("FSI", (FSI_SERVER,), (FSI_SERVER, r"<fsi-viewer")),
    ("LizardTech", (r"(?i)/lizardtech/iserv/calcrgn\?",), ()),
    ("VLS", (r"/(thumbview|pageview|zoom)/\d+\z",), ()),
    ("Micrio", (r"rijksmuseum.nl/en/rijksstudio", r"/api/getTilesInfo\?object_id="), (r"data-role=\"micrio\"", r"dataSourcePath\s*:\s*\".*\"")),
    ("Generic", (r"\{\{[XYxy](?::.\d+)?\}\}",), ()),
    ("Arts & Culture", (r"artsandculture\.google\.com", r"/g.co/arts/"), ()),
    ("Hungaricana", (r"hungaricana\.hu", r"\.ecw\z"), (r"(imagepath|files ).*\.ecw",)),
    ("Mnesys", (r"/datas/playlists/.*\.xml(\?.*)?\z", r"/p.xml\z"), (r"naoned_viewer", r"flashVars.*playlist=.*\.xml")),
    ("WMTS", (r"(?i)\bwmts\b",), ()),
    ("pnav", (r"/entity/OBJECT/\d+",), ()),
)
FRAME = r"(?i)<i?frame[^>]*\bsrc=[\"']([^\"']+)"


def as_rules(part: int, rules=RULES) -> list[Rule]:
    """The URL patterns (part 0) or page patterns (part 1) as rows, numbered by priority."""
    every = [(name, p) for name, *patterns in rules for p in patterns[part]]
    return [Rule(k, name, p) for k, (name, p) in enumerate(every)]


def _first(text: Column, part: int, rules=RULES) -> Column:
    """Each pattern is tried only on texts that hold the literals it needs, as looking for those is far cheaper."""

    def of(x: Column) -> Column:
        return F.coalesce(F.lit(None).cast("string"), *(F.when(guard(x["text"], x["low"], r.pattern), r.format) for r in as_rules(part, rules)))

    # In a higher-order function, as the compiled code of all patterns in several branches grows too large.
    return F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), of)[0]


def by_url(url: Column, rules=RULES) -> Column:
    """The first format one of whose URL patterns is found in an http(s) URL, or null."""
    return F.when(url.startswith("http"), _first(url, 0, rules))


def by_content(body: Column, rules=RULES) -> Column:
    """The first format one of whose page patterns is found, or null."""
    return _first(body, 1, rules)


def by_index(pages: DataFrame, index: RuleIndex, text: str = "body") -> DataFrame:
    """Adds format and rule, of the first rule of an index whose pattern is found in the column `text`, to any pages.

    The same answers as trying all patterns in order, at a cost that hardly depends on how many there are: one pass names
    the candidates, and their patterns run until one matches. Null texts match nothing.
    """
    named = pages.withColumn("__candidates", index.candidates(F.col(text)))
    hit = named.withColumn("__hit", index.first(F.col(text), F.col("__candidates")))
    return hit.withColumns({"format": index.format(F.col("__hit")), "rule": index.number(F.col("__hit"))}).drop("__candidates", "__hit")


def frames_of(body: Column, url: Column) -> Column:
    """The URLs of a page's frames, in their order."""
    return F.transform(frame_links(decode_entities(body)), lambda src: resolve_relative(src, url))


def frame_links(page: Column) -> Column:
    """The links of a decoded page's frames, in their order."""
    return F.when(F.lower(page).contains("frame"), F.regexp_extract_all(page, F.lit(FRAME), F.lit(1))).otherwise(F.when(page.isNotNull(), F.array().cast("array<string>")))


def detect(requests: DataFrame, documents: DataFrame, depth: int | None = None, rules=RULES) -> DataFrame:
    """Adds format, found_url (the URL to open: the request's or a frame's) and error to requests (request_id, url[, format]).

    A format that a request brings along is kept, whatever its URL and its page say, if the URL is one of http(s).
    URLs decide without any page. The others are walks over documents (url, body), each distinct URL one: a page that
    matches decides, else its frames are followed, breadth first and never twice, so cycles end; of several pages of a level
    the earlier one wins. `depth` bounds the steps. A level is written before the next one starts, and levels end with the
    deepest frames that there are. Of documents that repeat a URL the least body counts. Rows that repeat a request are
    kept each; null URLs are errors.
    """
    own = F.when(F.col("url").startswith("http"), F.col("format")) if "format" in requests.columns else F.lit(None).cast("string")
    requests = requests.withColumn("own", own).select("request_id", "url", F.coalesce("own", by_url(F.col("url"), rules)).alias("format"))
    done = requests.filter("format is not null").select("request_id", "url", "format", F.col("url").alias("found_url"))
    rest = requests.filter("format is null").select("request_id", "url")

    decoded, named, links = decode_entities(F.col("body")), by_content(F.col("page"), rules), frame_links(F.col("page"))

    def read(pages: DataFrame) -> DataFrame:
        told = pages.withColumn("page", decoded).drop("body").withColumn("value", named)
        return told.select("kind", "url", F.col("value").isNotNull().alias("done"), "value", F.when(F.col("value").isNull(), links).alias("next"))

    walks = closure(rest.filter("url like 'http%'").select(F.lit("page").alias("kind"), F.col("url").alias("start")), documents, read, depth)
    found = walks.select(F.col("start").alias("url"), F.try_element_at("trail", F.lit(-1)).alias("format"), "found_url").filter("found_url is not null")
    by_page = meet(rest, found, ["url"], ["request_id"]).select("request_id", "url", "format", "found_url")
    error = F.when(F.coalesce(F.col("url").startswith("http"), F.lit(False)), F.when(F.col("format").isNull(), "No format was found.")).otherwise("The URL must begin with http.")
    return done.unionByName(by_page).withColumn("error", error)
