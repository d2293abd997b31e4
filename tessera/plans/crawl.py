"""From requested URLs to tiles, over a crawl: which format, which metadata documents, what geometry, which tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import detect, discover, grid, parse, tileurl
from tessera.operators.closure import bodies, closure
from tessera.operators.formats import BUILT_IN, Formats
from tessera.sources.shared import Written, meet, shuffled

#: Formats whose metadata is in several documents, and what is added to the metadata URL for the first of them.
SEVERAL = {"Zoomify PFF": "&requestType=1", "krpano": ""}


def _reads(formats: list[str]):
    """read() of closure() for metadata: a document ends the walk unless its format has it name another one.

    A header of a tile file asks for its index, at places that the header tells; the two are read one after the other. A
    scene without levels leads to the scenes that it includes.
    """

    kind, body = F.col("kind"), F.col("body")
    done, links = F.lit(True), F.lit(None).cast("array<string>")
    if "Zoomify PFF" in formats:
        first = F.regexp_replace(F.col("url"), r"&requestType=1\z", "")
        header = (kind == "Zoomify PFF") & F.col("url").rlike(r"&requestType=1\z")
        begin, end = parse.pff_index(body)
        index = F.concat(first, F.lit("&requestType=2&begin="), begin.cast("string"), F.lit("&end="), end.cast("string"))
        done, links = F.when(header & index.isNotNull(), False).otherwise(done), F.when(header, F.array(index)).otherwise(links)
    if "krpano" in formats:
        scene = kind == "krpano"
        levels, includes = parse.scene_levels(F.when(scene, body)), parse.scene_includes(F.when(scene, body))
        done, links = F.when(scene, F.size(levels) > 0).otherwise(done), F.when(scene, includes).otherwise(links)

    def read(docs: DataFrame) -> DataFrame:
        return docs.select("kind", "url", done.alias("done"), F.lit(None).cast("string").alias("value"), links.alias("next"))

    return read


def fetched(told: DataFrame, documents: DataFrame, formats: list[str]) -> DataFrame:
    """told (format, meta_url, ...) with body, the metadata that parse() reads, or else missing, the document that the crawl lacks.

    Most formats have one document. Of an index in a second request both are joined by a line end; of a scene and its
    includes the first that names levels counts, in the order of a walk over includes; links are relative to the first.
    """
    start = F.col("meta_url")
    for name, end in SEVERAL.items():
        start = F.when(F.col("format") == name, F.concat("meta_url", F.lit(end))).otherwise(start)
    rows = told.withColumn("__start", start)
    starts = rows.filter("meta_url is not null").select(F.col("format").alias("kind"), F.col("__start").alias("start"))
    walks = Written(told.sparkSession, "walks")
    walks = walks.put(closure(starts, documents, _reads(formats), from_start=True).select("kind", "start", "found_url", "needs_url"), "walks")
    # Walks carry URLs alone; the bodies that they end at, and headers, are joined once.
    header = F.when((F.col("kind") == "Zoomify PFF") & (F.col("found_url") != F.col("start")), F.col("start"))
    held = bodies(documents, walks.select(F.col("found_url").alias("url")).unionByName(walks.select(header.alias("url"))))
    read = walks.join(shuffled(held.withColumnsRenamed({"url": "found_url"})), "found_url", "left")
    if "Zoomify PFF" in formats:
        read = read.withColumn("header", header).join(shuffled(held.select(F.col("url").alias("header"), F.col("body").alias("head"))), "header", "left").withColumn("body", F.concat_ws("\n", "head", "body"))
    facts = read.select(F.col("kind").alias("format"), F.col("start").alias("__start"), F.when(F.col("found_url").isNotNull(), F.col("body")).alias("body"), F.col("needs_url").alias("missing"))
    return rows.join(shuffled(facts), ["format", "__start"], "left").drop("__start")


def describe(requests: DataFrame, documents: DataFrame, formats: list[str] | Formats) -> DataFrame:
    """Descriptors of requests (request_id, url[, format]) by documents (url, body): a row for each request, of those that fail too.

    error says why a request has no geometry, and failed_at at which step: detect, discover, fetch (needs_url is the
    document that the crawl lacks) or parse. Documents meet requests in equi-joins by URL only, as distinct URLs, so a URL
    that is asked for often costs one row of the crawl and is parsed once; of documents that repeat a URL the least body
    counts. Each step is written once, so that the next one's branches read it instead of repeating it. formats names
    built-in formats (pages of others are detected and are errors later), or is a registry of one's own.
    """
    tables = Written(requests.sparkSession, "crawl")
    registry = formats if isinstance(formats, Formats) else BUILT_IN
    formats = registry.names if isinstance(formats, Formats) else formats
    found = detect.detect(requests, documents, rules=registry.rules).select("request_id", F.coalesce("found_url", "url").alias("url"), "format", F.col("error").alias("undetected"))
    opened = tables.put(found, "detected")
    told = discover.discover(opened.filter("undetected is null"), documents, formats, registry.discoveries).withColumnRenamed("error", "undiscovered")
    known = tables.put(told.unionByName(opened.filter("undetected is not null"), allowMissingColumns=True), "discovered")
    # Each different metadata URL of a format is fetched and parsed once.
    metas = tables.put(fetched(known.filter("meta_url is not null").select("format", "meta_url").distinct(), documents, formats), "fetched")
    read = metas.filter("body is not null").select(F.monotonically_increasing_id().alias("request_id"), F.col("meta_url").alias("url"), "format", "body")
    parsed = tables.put(parse.parse(read, formats, registry.parsers).drop("request_id", "needs_url"), "parsed").withColumn("parsed", F.lit(True)).withColumnRenamed("error", "unread")
    lost = metas.filter("body is null").select("format", F.col("meta_url").alias("url"), F.coalesce("missing", "meta_url").alias("lost"), F.when(F.col("missing").isNull(), F.lit(True)).alias("empty"))
    facts = parsed.unionByName(lost, allowMissingColumns=True).withColumnsRenamed({"url": "meta_url"})
    rows = meet(known, facts, ["format", "meta_url"], ["request_id"], salts=4)
    missing = F.coalesce("needs_url", F.when(F.coalesce("empty", F.lit(False)), F.lit(None)).otherwise(F.col("lost")))
    at: Column = F.when(F.col("undetected").isNotNull(), "detect").when(F.col("undiscovered").isNotNull(), "discover").when(missing.isNotNull(), "fetch").when(F.coalesce("empty", F.lit(False)) | F.col("unread").isNotNull(), "parse")
    none = F.when(F.coalesce("empty", F.lit(False)), F.concat(F.lit("No document tells the geometry: "), F.col("meta_url")))
    why = F.coalesce("undetected", "undiscovered", F.concat(F.lit("Not in the crawl: "), missing), none, "unread")
    out = rows.withColumns({"failed_at": at, "error": why, "__missing": missing, "url": F.coalesce("meta_url", "url")})
    return out.withColumn("needs_url", F.col("__missing")).drop("__missing", "undetected", "undiscovered", "unread", "parsed", "lost", "empty", "meta_url")


def tiles(descriptors: DataFrame, formats: list[str] | Formats, keys: dict | None = None) -> DataFrame:
    """Places and URLs of the tiles of describe()'s descriptors; nothing is shuffled. keys are those of formats that sign their URLs."""
    planned = grid.plan_tiles(tileurl.with_origin_parts(descriptors.filter("failed_at is null")))
    if isinstance(formats, Formats):
        own = formats.builders(keys)
        return tileurl.with_tile_urls(planned, list(own), builders=own).drop("origin_parts")
    return tileurl.with_tile_urls(planned, formats, keys=keys).drop("origin_parts")
