"""Requests and tile results as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.detect import by_url
from tessera.operators.grid import plan_tiles
from tessera.operators.tileurl import with_tile_urls


def detected(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The format of each new URL of a stream (ts, request_id, url); URLs seen within `late` are dropped."""
    fresh = requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"])
    return fresh.withColumn("format", by_url(F.col("url")))


def planned(images: DataFrame, formats: list[str]) -> DataFrame:
    """Tiles with URLs for a stream of descriptors; stateless."""
    return with_tile_urls(plan_tiles(images), formats)


def loaded_by_window(results: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Tiles loaded and failed in each window, from a stream (ts, image_id, status)."""
    counts = results.withWatermark("ts", late).groupBy(F.window("ts", window), "image_id")
    return counts.agg(F.count_if(F.col("status") == "ok").alias("loaded"), F.count_if(F.col("status") != "ok").alias("failed"))
