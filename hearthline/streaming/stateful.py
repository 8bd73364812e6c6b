"""Streams with state per key: price changes, and presence by event-time timers.

State lives in Spark's RocksDB store, one small row for each key. A micro-batch
reads and writes the rows of its own keys only; no table is rewritten. Results
are ordinary streams, so a file sink writes each of them exactly once, also
after a restart from the checkpoint.

Times travel as microseconds of zone-less UTC, so the session has to run in UTC.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hearthline.functions.exprs import pct_change
from hearthline.streaming.jobs import event_time

# Tasks get the processors by value, so executors need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Queries started from now on keep their state on disk, with changes logged to the checkpoint."""
    spark.conf.set(STORE, ROCKSDB)


def micros(column: Column | str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))


def from_micros(column: str) -> Column:
    return F.timestamp_micros(column).cast("timestamp_ntz")


def in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[np.ndarray]:
    """The rows of a key in this batch as arrays, ordered by the columns from the first on."""
    parts = list(rows)
    arrays = [np.concatenate([p[c].to_numpy() for p in parts]) if len(parts) > 1 else parts[0][c].to_numpy() for c in columns]
    if len(arrays[0]) == 1:
        return arrays
    order = np.lexsort(arrays[::-1])
    return [a[order] for a in arrays]


class PriceChanges(StatefulProcessor):
    """Steps between consecutive prices of a key; the state is its newest price."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, price = in_order(rows, ["at", "price"])
        before = self.last.get()
        if before is not None:
            newer = at > before[1]
            at, price = np.append(before[1], at[newer]), np.append(before[0], price[newer])
        if before is None or len(at) > 1:
            self.last.update((float(price[-1]), int(at[-1])))
        step = np.flatnonzero(price[1:] != price[:-1])
        if not len(step):  # a frame costs as much as all the rest of a key
            return
        yield pd.DataFrame({"key": np.full(len(step), key[0]), "old_price": price[step], "new_price": price[step + 1], "at": at[step + 1]})

    def close(self) -> None:
        pass


def price_changes(observations: DataFrame) -> DataFrame:
    """Stream of (key, old_price, new_price, pct, at) from a stream of (key, price, at).

    Every change between consecutive observations of a key is emitted once, in
    whatever batches they arrive. Observations not newer than the stored one of an earlier
    batch are ignored; ties in time inside a batch go by price. Rows without key, price or time are left out.
    """
    keep_state_in_rocksdb(observations.sparkSession)
    rows = observations.where("key IS NOT NULL AND price IS NOT NULL AND at IS NOT NULL").select(F.col("key").cast("bigint"), F.col("price").cast("double"), micros("at").alias("at"))
    steps = rows.groupBy("key").transformWithStateInPandas(PriceChanges(), "key bigint, old_price double, new_price double, at bigint", "Append", "None")
    return steps.select("key", "old_price", "new_price", pct_change(F.col("new_price"), F.col("old_price")).alias("pct"), from_micros("at").alias("at"))


class Presence(StatefulProcessor):
    """Removal after silence and return after it. The state is the running stay of a key (first and last sighting, number of sightings) and whether it has ended."""

    COLUMNS = ["key", "event", "sightings", "first_seen_at", "last_seen_at", "at"]

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stay = handle.getValueState("stay", "first bigint, last bigint, sightings bigint, present boolean")

    def due(self, last: int) -> int:
        """Milliseconds at which the silence after ``last`` is over."""
        return -(-(last + self.silence) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (at,) = in_order(rows, ["at"])
        known = self.stay.get()
        armed = self.due(known[1]) if known is not None and known[3] else None
        out = []
        # stays inside the batch begin where a gap is as long as the silence
        starts = np.append(0, np.flatnonzero(np.diff(at) >= self.silence) + 1)
        ends = np.append(starts[1:], len(at))
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            first, last, n = int(at[a]), int(at[b - 1]), b - a
            if known is not None and known[3] and first < known[1] + self.silence:
                first, last, n = min(known[0], first), max(known[1], last), n + known[2]
            elif known is not None:
                if known[3]:
                    out.append((key[0], "removed", known[2], known[0], known[1], known[1] + self.silence))
                out.append((key[0], "returned", n, first, first, first))
            known = (first, last, n, True)
        # the timer of the last stay only: each call is a round trip
        if armed != self.due(known[1]):
            if armed is not None:
                self.handle.deleteTimer(armed)
            self.handle.registerTimer(self.due(known[1]))
        self.stay.update(known)
        if out:  # a frame costs as much as all the rest of a key
            yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, n, present = self.stay.get()
        out = []
        if present and self.due(last) <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], "removed", n, first, last, last + self.silence))
            self.stay.update((first, last, n, False))
            yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def presence_events(sightings: DataFrame, silence_hours: float, delay: str = "0 seconds") -> DataFrame:
    """Stream of (key, event, sightings, first_seen_at, last_seen_at, at) from a stream of sightings (key, at).

    ``removed``: a key was not seen for ``silence_hours`` after its last
    sighting; it is emitted when the watermark passes ``at``, the end of the
    silence, or when a later sighting proves it. ``returned``: a removed key is
    seen again at ``at``; ``sightings`` then counts those of this batch. Each sighting re-arms the
    key's only timer. A sighting older than the last one of its stay only counts.
    """
    keep_state_in_rocksdb(sightings.sparkSession)
    timed = event_time(sightings.where("key IS NOT NULL AND at IS NOT NULL").select(F.col("key").cast("bigint"), "at"), delay)
    rows = timed.select("key", F.col("at").alias("event_at"), micros("at").alias("at"))
    schema = "key bigint, event string, sightings bigint, first_seen_at bigint, last_seen_at bigint, at bigint"
    events = rows.groupBy("key").transformWithStateInPandas(Presence(round(silence_hours * 3_600_000_000)), schema, "Append", "EventTime")
    return events.select("key", "event", "sightings", from_micros("first_seen_at").alias("first_seen_at"), from_micros("last_seen_at").alias("last_seen_at"), from_micros("at").alias("at"))
