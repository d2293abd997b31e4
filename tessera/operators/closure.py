"""Documents that lead to documents: a fixpoint over a frontier of URLs.

Frames of pages, includes of scenes and second requests for an index are all the same walk: read the documents of a round,
and what they name and nobody has asked for yet is the next round's frontier. A round reads each URL once however many
walks meet there, joins the crawl as distinct URLs only, and is written once; a round that finds nothing to read ends the
loop, so rounds are as many as the longest walk is deep, and that one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import resolve_relative
from tessera.sources.shared import Written, meet, shuffled


def bodies(documents: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, body) of the distinct urls (url) that documents (url, body) hold; of those that repeat a URL the least body counts."""
    return documents.select("url", "body").join(shuffled(urls.select("url").filter("url is not null").distinct()), "url", "left_semi").groupBy("url").agg(F.min("body").alias("body"))


def closure(starts: DataFrame, documents: DataFrame, read: Callable[[DataFrame], DataFrame], limit: int | None = None, from_start: bool = False) -> DataFrame:
    """(kind, start, found_url, level, trail, needs_url), a row for each distinct (kind, start) of starts (kind, start).

    read takes (kind, url, body) and returns (kind, url, done, value, next): whether a document ends the walk, what it tells
    as a text, and the links that it leads to, in order. Links are resolved against the document's URL, or against the
    start's with from_start. A walk goes breadth first, in the order of the links, and ends at the first document that is
    done: found_url, the number of steps to it, and the values on the way with its own last. Where none is done, found_url
    is null and needs_url the first document on the way that is not in the crawl.

    A URL is visited once by a walk, so cycles end; `limit` bounds the steps (0: the start alone). Null and repeated links
    are skipped, null starts find nothing. No starts give no rows.
    """
    tables = Written(starts.sparkSession, "closure")
    starts = tables.put(starts.select("kind", "start").distinct(), "starts")
    none = F.array().cast("array<string>")
    frontier = starts.filter("start is not null").select("kind", "start", F.col("start").alias("url"), F.array().cast("array<int>").alias("place"), none.alias("trail"))
    mets = []
    while True:
        asked = frontier.select("kind", "url").distinct()
        facts = read(asked.join(shuffled(bodies(documents, asked)), "url").select("kind", "url", "body")).select("kind", "url", F.coalesce("done", F.lit(False)).alias("done"), "value", F.coalesce("next", none).alias("next"))
        trail = F.concat("trail", F.when(F.col("value").isNull(), none).otherwise(F.array("value")))
        mets.append(met := tables.put(meet(frontier, facts, ["kind", "url"], ["start"]).withColumn("trail", trail).drop("value"), "met"))
        if limit is not None and len(mets) > limit or met.isEmpty():
            break
        ended = met.filter("done").select("kind", "start").distinct()
        going = met.filter("not done").join(shuffled(ended), ["kind", "start"], "left_anti")
        links = going.select("kind", "start", "place", "trail", F.col("start" if from_start else "url").alias("base"), F.posexplode("next").alias("k", "link")).filter("link is not null")
        links = links.select("kind", "start", resolve_relative(F.col("link"), F.col("base")).alias("url"), F.concat("place", F.array("k")).alias("place"), "trail")
        fresh = links.groupBy("kind", "start", "url").agg(F.min(F.struct("place", "trail")).alias("first"))
        fresh = fresh.join(shuffled(tables.all(mets).select("kind", "start", "url")), ["kind", "start", "url"], "left_anti")
        frontier = fresh.select("kind", "start", "url", "first.place", "first.trail")
    # A place has a number for each step. (A round's own number in the plan would have Spark compile each round anew.)
    here = F.struct(F.size("place").alias("level"), "place", "url", "trail")
    ends = tables.all(mets).groupBy("kind", "start").agg(F.min(F.when(F.col("done"), here)).alias("found"), F.min(F.when(F.col("done").isNull(), here)).alias("lost"))
    out = starts.join(shuffled(ends), ["kind", "start"], "left")
    lost = F.when(F.col("found").isNull(), F.col("lost.url"))
    return out.select("kind", "start", F.col("found.url").alias("found_url"), F.col("found.level").alias("level"), F.col("found.trail").alias("trail"), lost.alias("needs_url"))
