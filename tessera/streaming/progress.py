"""How far each image has come, as keyed state of a stream of plans and tile results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs, for the session's settings.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SCHEMA = "image_id long, at long, kind string, loaded long, failed long, total long, percent int, first_error string"


class Progress(StatefulProcessor):
    """One image: counts of its tiles, what was last told of it, and when it was last heard of."""

    def __init__(self, tick_ms: int, expire_ms: int):
        self.tick_ms, self.expire_ms = tick_ms, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "loaded long, failed long, total long, error_seq long, error string, told long, at long, done boolean")

    def _row(self, key, at: int, kind: str, loaded: int, failed: int, total: int | None, error: str | None) -> pd.DataFrame:
        percent = None if not total else min(100, 100 * loaded // total)
        return pd.DataFrame({"image_id": [key[0]], "at": [at], "kind": [kind], "loaded": [loaded], "failed": [failed], "total": pd.array([total], "Int64"), "percent": pd.array([percent], "Int32"), "first_error": [error]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.counts.get() if self.counts.exists() else (0, 0, None, None, None, -1, None, False)
        loaded, failed, total, seq, error, told, at, done = state
        if done:  # what comes after the end of an image changes nothing
            return
        for frame in rows:
            planned = frame["total_tiles"].dropna()
            if len(planned):
                total = int(planned.iloc[0]) if total is None else total
            good = int((frame["status"] == "ok").sum())
            bad = frame[frame["status"].notna() & (frame["status"] != "ok")]
            loaded, failed = loaded + good, failed + len(bad)
            if len(bad):
                first = bad.sort_values("seq", kind="stable").iloc[0]
                if seq is None or int(first["seq"]) < seq:
                    seq, error = int(first["seq"]), first["error"]
            newest = int(frame["ms"].max())
            at = newest if at is None else max(at, newest)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if total is not None and loaded >= total:
            done = True
            yield self._row(key, at, "done", loaded, failed, total, error)
        else:
            # At the next tick after the newest row, if anything is new, and when nothing has come for long.
            self.handle.registerTimer((at // self.tick_ms + 1) * self.tick_ms)
        self.handle.registerTimer(at + self.expire_ms)
        self.counts.update((loaded, failed, total, seq, error, told, at, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.counts.exists():
            return
        loaded, failed, total, seq, error, told, at, done = self.counts.get()
        when = expiredTimerInfo.getExpiryTimeInMs()
        if when >= at + self.expire_ms:
            self.counts.clear()
            if not done:
                yield self._row(key, when, "given up", loaded, failed, total, error)
        elif not done and loaded + failed != told:
            self.counts.update((loaded, failed, total, seq, error, loaded + failed, at, done))
            yield self._row(key, when, "progress", loaded, failed, total, error)

    def close(self) -> None:
        pass


def progress_events(rows: DataFrame, late: str = "10 seconds", tick_ms: int = 500, expire_ms: int = 3_600_000) -> DataFrame:
    """(image_id, at, kind, loaded, failed, total, percent, first_error) from a stream (ts, image_id, total_tiles, seq, status, error).

    Rows with total_tiles plan an image, rows with a status are results of its tiles; either may come first, and of several
    plans the first counts. An image is told of at each tick of event time after something new (`progress`), once when as
    many tiles are loaded as planned (`done`; what comes later changes nothing), and once if nothing has come for
    expire_ms (`given up`), when its state is dropped, as that of finished images is. first_error is that of the smallest
    seq. Rows later than the watermark are dropped.

    State is two numbers of timers and one row an image, in the state store that STATE_STORE sets; there is no bound on
    images or rows in memory.
    """
    events = rows.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")).select("ts", "ms", "image_id", "total_tiles", "seq", "status", "error")
    told = events.groupBy("image_id").transformWithStateInPandas(statefulProcessor=Progress(tick_ms, expire_ms), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
    return told.withColumn("at", F.timestamp_millis("at"))
