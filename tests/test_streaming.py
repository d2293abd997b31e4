"""The streams of plans.py over files, each read to its end."""

import datetime

from tessera.streaming import plans

START = datetime.datetime(2024, 5, 1, 12, 0)


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drained(spark, df, tmp_path, name):
    """All rows written so far; a further call goes on where the last one ended."""
    out = str(tmp_path / f"{name}-out")
    query = df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.read.parquet(out).collect()


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_repeated_urls_are_dropped(spark, tmp_path):
    rows = [(at(0), 1, "http://h/a.dzi"), (at(1), 2, "http://h/a.dzi"), (at(2), 3, "http://h/?FIF=x"), (at(3), 4, None), (at(4), 5, "http://h/plain")]
    found = drained(spark, plans.detected(stream(spark, tmp_path, rows, "ts timestamp, request_id long, url string")), tmp_path, "fresh")
    assert sorted((r.url or "", r.format) for r in found) == [("", None), ("http://h/?FIF=x", "IIPImage"), ("http://h/a.dzi", "Seadragon"), ("http://h/plain", None)]


def test_tiles_of_streamed_descriptors(spark, tmp_path):
    rows = [(1, "IIIF", "http://h/i", 500, 330, 200, "default", "jpg"), (2, "IIIF", "http://h/j", 100, 90, 200, "default", "png")]
    schema = "image_id long, format string, origin string, width int, height int, tile_size int, quality string, image_format string"
    found = drained(spark, plans.planned(stream(spark, tmp_path, rows, schema), ["IIIF"]), tmp_path, "tiles")
    assert len(found) == 7
    assert [r.url for r in found if r.image_id == 2] == ["http://h/j/0,0,100,90/100,90/0/default.png"]


def test_late_results_miss_their_window(spark, tmp_path):
    schema = "ts timestamp, image_id long, status string"
    results = stream(spark, tmp_path, [(at(0.1), 1, "ok"), (at(0.2), 1, "error"), (at(0.3), 2, "ok"), (at(1.5), 1, "ok"), (at(30), 3, "ok")], schema)
    counts = plans.loaded_by_window(results)
    first = drained(spark, counts, tmp_path, "windows")
    assert sorted((r.image_id, r.loaded, r.failed) for r in first) == [(1, 1, 0), (1, 1, 1), (2, 1, 0)]
    # The watermark stands at minute 20: what comes for minute 0 is late, what comes for minute 25 isn't.
    stream(spark, tmp_path, [(at(0.4), 2, "ok"), (at(25), 2, "error"), (at(60), 4, "ok")], schema)
    later = drained(spark, counts, tmp_path, "windows")
    assert sorted((r.image_id, r.loaded, r.failed) for r in later) == [(1, 1, 0), (1, 1, 1), (2, 0, 1), (2, 1, 0), (3, 1, 0)]
