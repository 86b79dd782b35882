"""Sessions of runs as a state machine with timers: a run that falls silent is closed, and its state goes.

``progress.run_state`` folds all events a run ever had, so its state lives for ever.  Here the state of a run is one small
row that exists while a session is open: it ends with a final event (complete or error) or when no event came for
``SILENCE`` of event time, by a timer on the watermark.  So a stream over years holds the runs of the last hour.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusreview.streaming.progress import STATES

#: Seconds of event time without an event after which an open session has failed.
SILENCE = 3600
FINAL = ("complete", "error")
SILENT = "failed"
SESSION = "run_id bigint, started timestamp, last_at timestamp, events bigint, files bigint, state string, closed boolean"
_STATE = "started bigint, last_at bigint, events bigint, files bigint, state string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunSession(StatefulProcessor):
    """State of a run: when its open session began and was heard of last (microseconds), what it counted and where it stands.

    Events of a batch are taken in the order of time, then ``seq``; a gap of more than the silence inside a batch closes a
    session just as the timer does between batches.  Each session gives a row whenever a batch changes or closes it.
    """

    def __init__(self, silence: int):
        self.silence = silence * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("session", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values(["ts", "seq"], kind="stable")
        times = events["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        now = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for at, event in zip(times.tolist(), events["event"]):
            if now is not None and at - now[1] > self.silence:
                out.append((*now[:4], SILENT, True))
                now = None
            started, last, count, files, state = now or (at, at, 0, 0, "cloning")
            now = (started, max(at, last), count + 1, files + (event == "file_start"), STATES.get(event, state))
            if now[4] in FINAL:
                out.append((*now, True))
                now = None
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if now is None:
            self.open.clear()
        else:
            self.open.update(now)
            # a timer is in whole milliseconds: it fires after the last moment at which an event would join the session
            self.handle.registerTimer((now[1] + self.silence) // 1000 + 1)
            out.append((*now, False))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            out.append((*tuple(self.open.get())[:4], SILENT, True))
            self.open.clear()
        yield self._rows(key, out)

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, sessions: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(sessions, columns=["started", "last_at", "events", "files", "state", "closed"])
        frame.insert(0, "run_id", key[0])
        for c in ("started", "last_at"):
            frame[c] = pd.to_datetime(frame[c], unit="us")
        return frame


def run_sessions(events: DataFrame, silence: int = SILENCE, delay: str = "0 seconds") -> DataFrame:
    """Changed and closed sessions of a stream of ``run_id, seq, ts, event``: the columns of ``SESSION``.

    ``delay`` is how late events may come.  The newest row of each ``run_id, started`` counts.  State is kept by RocksDB;
    start the query with ``with_rocksdb``.
    """
    known = events.select("run_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "event").withWatermark("ts", delay)
    return known.groupBy("run_id").transformWithStateInPandas(RunSession(silence), SESSION, "Update", "eventTime")


def with_rocksdb(spark: SparkSession, start):
    """Call ``start``, which starts a query, with RocksDB as the state store of the session; other queries keep theirs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
