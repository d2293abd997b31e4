"""The size of grids that no document tells: which tiles exist is found out by asking for some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tileurl import generic, template_parts
from tessera.sources.shared import Written, shuffled

#: Tiles along a side, at most; the least side of a tile.
MOST, TILE = 1000, 256


def search_grids(requests: DataFrame, probe: Callable[[DataFrame], DataFrame], most: int = MOST) -> DataFrame:
    """(request_id, url, format, origin, width, height, tile_size, error, rounds) for requests (request_id, url) with a URL template.

    Tiles of row 0 and of column 0 are bisected: between a tile that exists and one that doesn't the middle one is asked
    for, for both sides of all images in the same round, so that ten rounds tell of a thousand tiles a side. probe takes
    distinct URLs (url) and returns (url, ok, width, height), from a table of a crawl or from fetching; what it doesn't
    return doesn't exist. There is one tile a side at least, and `most` at most. A tile's size is the largest smaller side
    of what was loaded, 256 at least; as the last tile down a side may be cut, the last one asked for doesn't count.

    Each round is written. Templates that repeat are asked for once a round; rows that repeat a request are kept each, and
    null templates are errors. No rows give no rows.
    """
    tables = Written(requests.sparkSession, "search")
    requests = requests.select("request_id", "url")
    state = requests.select("url").filter("url is not null").distinct().withColumn("template_parts", template_parts("url", "Generic"))
    for side in "xy":
        state = state.withColumns({f"low_{side}": F.lit(0), f"high_{side}": F.lit(most)})
    state = tables.put(state.withColumns({"tile": F.lit(TILE), "rounds": F.lit(0)}), "state")
    middle = lambda side: F.floor((F.col(f"low_{side}") + F.col(f"high_{side}")) / 2).cast("int")
    open_ = lambda side: F.col(f"low_{side}") + 1 < F.col(f"high_{side}")
    while not state.filter(open_("x") | open_("y")).isEmpty():
        asked = state
        for side, (x, y) in {"x": (middle("x"), F.lit(0)), "y": (F.lit(0), middle("y"))}.items():
            asked = asked.withColumns({"x": x, "y": y}).withColumn(f"ask_{side}", F.when(open_(side), generic(F.col("template_parts")))).drop("x", "y")
        asked = tables.put(asked, "asked")
        urls = asked.select(F.col("ask_x").alias("url")).unionByName(asked.select(F.col("ask_y").alias("url"))).filter("url is not null").distinct()
        seen = tables.put(probe(urls).filter("ok").select("url", F.least("width", "height").alias("side")).groupBy("url").agg(F.max("side").alias("side")), "seen")
        next_ = asked
        for side in "xy":
            next_ = next_.join(shuffled(seen.select(F.col("url").alias(f"ask_{side}"), F.coalesce("side", F.lit(0)).alias(f"side_{side}"))), f"ask_{side}", "left")
        last = open_("y") & (F.col("high_y") - F.col("low_y") <= 2)
        tile = F.greatest("tile", F.coalesce("side_x", F.lit(0)), F.when(last, 0).otherwise(F.coalesce("side_y", F.lit(0))))
        columns = {"tile": tile, "rounds": F.col("rounds") + (open_("x") | open_("y")).cast("int")}
        for side in "xy":
            there = F.col(f"side_{side}").isNotNull()
            columns |= {f"low_{side}": F.when(open_(side) & there, middle(side)).otherwise(F.col(f"low_{side}")), f"high_{side}": F.when(open_(side) & ~there, middle(side)).otherwise(F.col(f"high_{side}"))}
        after = tables.put(next_.select("url", "template_parts", *(c.alias(n) for n, c in columns.items())), "state")
        tables.drop(state, asked, seen)
        state = after
    found = state.select("url", *((F.col(f"high_{s}").cast("bigint") * F.col("tile")).alias(n) for s, n in (("x", "width"), ("y", "height"))), F.col("tile").alias("tile_size"), "rounds")
    out = requests.join(shuffled(found), "url", "left").withColumn("error", F.when(F.col("url").isNull(), "There is no template."))
    return out.select("request_id", "url", F.lit("Generic").alias("format"), F.col("url").alias("origin"), "width", "height", "tile_size", "error", "rounds")
