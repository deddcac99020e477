"""Handles with a time to live: register, single use, expiry.

``resolve`` judges a table of events in one pass; ``stream`` keeps the same state for an endless
one, a value for each handle with timers in place of a sweep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilspark.functions import fixed as X

OUT = "handle string, ts timestamp, op string, outcome string, payload string"


def register(mappings: DataFrame, at: str = "created_at") -> DataFrame:
    """A new random handle and the time for each row of a table of mappings.

    Materialize the result before using it twice: handles are drawn anew each time.
    """
    return mappings.withColumn("handle", F.uuid()).withColumn(at, F.current_timestamp())


def live(handles: DataFrame, now, ttl_seconds: float = X.TTL_SECONDS, at: str = "created_at") -> DataFrame:
    """Handles younger than the time to live; those of exactly that age are gone."""
    return handles.filter(_age(F.col(at), now) < ttl_seconds)


def swept(handles: DataFrame, now, ttl_seconds: float = X.TTL_SECONDS, at: str = "created_at") -> DataFrame:
    """Handles a sweep removes; their files are to be deleted."""
    return handles.filter(_age(F.col(at), now) >= ttl_seconds)


def _age(at, now):
    now = now if not isinstance(now, str) else F.to_timestamp(F.lit(now))
    return (F.unix_micros(now.cast("timestamp") if hasattr(now, "cast") else F.lit(now).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1e6


def resolve(events: DataFrame, ttl_seconds: float = X.TTL_SECONDS) -> DataFrame:
    """Outcome of each event (ts, op, handle[, payload]): registered, popped, closed or unknown.

    A pop or close finds the last register before it, if no other pop or close came between and
    it is younger than the time to live.  Events of one time go in the order register, pop, close.
    """
    rank = F.when(F.col("op") == "register", 0).when(F.col("op") == "pop", 1).otherwise(2)
    w = Window.partitionBy("handle").orderBy("ts", rank)
    payload = F.col("payload") if "payload" in events.columns else F.lit(None).cast("string")
    rows = events.filter("op in ('register', 'pop', 'close')").select("handle", "ts", "op", payload.alias("payload"))
    prior = F.lag(F.struct("op", "ts", "payload")).over(w)
    rows = rows.withColumn("_p", prior)
    found = (F.col("_p.op") == "register") & (_age(F.col("_p.ts"), F.col("ts")) < ttl_seconds)
    done = F.when(F.col("op") == "pop", "popped").otherwise("closed")
    outcome = F.when(F.col("op") == "register", "registered").when(F.coalesce(found, F.lit(False)), done).otherwise("unknown")
    return rows.select("handle", "ts", "op", outcome.alias("outcome"), F.when(outcome.isin("popped", "closed"), F.col("_p.payload")).alias("payload"))


class HandleProcessor(StatefulProcessor):
    """Value state for each handle; a timer removes it at its time to live."""

    def __init__(self, ttl_seconds: float = X.TTL_SECONDS):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "payload string, ts_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order = {"register": 0, "pop": 1, "close": 2}
        todo = [r for f in rows for r in f.itertuples(index=False)]
        for r in sorted(todo, key=lambda r: (r.ts, order.get(r.op, 3))):
            us = r.ts.value // 1000
            got = self.kept.get() if self.kept.exists() else None
            if got is not None and us - got[1] >= self.ttl * 1e6:
                self.kept.clear()
                got = None
            if r.op == "register":
                self.kept.update((r.payload, us))
                self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + self.ttl * 1000))
                yield _row(key, r, "registered", None)
            elif got is None:
                yield _row(key, r, "unknown", None)
            else:
                self.kept.clear()
                yield _row(key, r, "popped" if r.op == "pop" else "closed", got[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def _row(key, r, outcome: str, payload) -> pd.DataFrame:
    return pd.DataFrame({"handle": [key[0]], "ts": [r.ts], "op": [r.op], "outcome": [outcome], "payload": [payload]})


def stream(events: DataFrame, ttl_seconds: float = X.TTL_SECONDS) -> DataFrame:
    """As ``resolve`` for a streaming table; needs the RocksDB state store."""
    return events.groupBy("handle").transformWithStateInPandas(HandleProcessor(ttl_seconds), OUT, "Append", "ProcessingTime")


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window (an addition of this engine); works on tables and streams."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    return df.groupBy(F.window(ts, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
