"""City snapshots that arrive, serve and expire as state.

A stream carries two kinds of events: a city's snapshot, and an ask for a city.
An ask is answered by the city's latest snapshot that is not newer than the
ask and at most the age limit older; a snapshot of exactly that age still
serves, as in ``sources.snapshots.fresh``. Nothing is scanned for it: each city
keeps the snapshots that can still serve and the asks that wait, and timers in
event time answer and forget them.

An ask waits until the watermark has passed it, so the order in which events
arrive within the watermark's delay does not matter. A city with many asks is
dealt over ``salts`` groups; each of them gets the city's snapshots, which are
few beside the asks.

Times count in milliseconds. Events without a city or a time are dropped.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mealgrid.constants import SNAPSHOT_TTL_HOURS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "city_slug string, at timestamp, snapshot string, ask_id bigint"
SERVED = "city_slug string, kind string, ask_id bigint, at_ms bigint, snapshot string, snapshot_ms bigint"


def needs_timers(spark: SparkSession) -> None:
    """Timers live in the RocksDB state store; library functions change no settings."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKS}")


class Expiry(StatefulProcessor):
    """State of one city (and group of its asks): snapshots by time, asks by id."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.snapshots = handle.getMapState("snapshots", "ms bigint", "snapshot string")
        self.asks = handle.getMapState("asks", "ask_id bigint", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for ms, snapshot, ask in zip(pdf["ms"], pdf["snapshot"], pdf["ask_id"]):
                ms = int(ms)
                if pd.isna(ask):
                    self.snapshots.updateValue((ms,), (snapshot,))
                    self.handle.registerTimer(ms + self.ttl_ms + 1)
                else:
                    self.asks.updateValue((int(ask),), (ms,))
                    self.handle.registerTimer(ms)
        yield pd.DataFrame(columns=["city_slug", "kind", "ask_id", "at_ms", "snapshot", "snapshot_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted((int(k[0]), v[0]) for k, v in self.snapshots.iterator())
        waiting = sorted(int(k[0]) for k, v in self.asks.iterator() if int(v[0]) == now)
        serving = [s for s in held if now - self.ttl_ms <= s[0] <= now]
        out = []
        for ask in waiting:
            ms, snapshot = serving[-1] if serving else (None, None)
            out.append((key[0], "served" if serving else "missing", ask, now, snapshot, ms))
            self.asks.removeKey((ask,))
        gone = now - self.ttl_ms - 1
        for ms, snapshot in held:
            if ms == gone:
                self.snapshots.removeKey((ms,))
                # A later snapshot has taken its place; only the last one leaves the city without.
                if not serving and key[1] == 0:
                    out.append((key[0], "expired", None, now, snapshot, ms))
        frame = pd.DataFrame(out, columns=["city_slug", "kind", "ask_id", "at_ms", "snapshot", "snapshot_ms"])
        yield frame.astype({"ask_id": "Int64", "at_ms": "Int64", "snapshot_ms": "Int64"})

    def close(self) -> None:
        pass


def served(events: DataFrame, ttl_hours: float = SNAPSHOT_TTL_HOURS, delay: str = "10 minutes", salts: int = 1) -> DataFrame:
    """A stream of answers to asks, and of the moments at which cities lose their last snapshot.

    ``events`` has the columns of ``EVENTS``; an ask has an ``ask_id`` and a
    snapshot has none.
    """
    needs_timers(events.sparkSession)
    rows = events.where("city_slug is not null and at is not null").withWatermark("at", delay)
    ask = F.array(F.pmod(F.xxhash64("ask_id"), F.lit(salts)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    rows = rows.withColumn("salt", F.explode(F.when(F.col("ask_id").isNull(), every).otherwise(ask)))
    rows = rows.withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("city_slug", "salt").transformWithStateInPandas(
        Expiry(round(ttl_hours * 3_600_000)), SERVED, "Append", "EventTime"
    )
