"""Rules and chains that remember earlier batches, with results that do not hang on arrival.

Events may come in any order as long as none is later than the watermark: rows come out when
the watermark has passed what decides them, and equal those of the batch operators. What lies
between the watermark and the last event waits; ``end_of_input`` makes a row that belongs to
no rule and moves the watermark past all events, for a stream that ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracehound.operators.chains import SUSPICIOUS_STATUS
from tracehound.operators.rules import ThresholdRule
from tracehound.schema import KEY_COLUMNS, group_of, micros

_ALERT = "grp string, event_seq long, t long"

# The store that keeps state by key and time; stateful rules cannot run on the other one.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

_HORIZON_CELLS = 64  # an alert reaches waiting events at most a cell of its address later

_BEFORE_TIME = -62_135_596_800_000_000
_NO_TIME = (1 << 63) - 1


def configure_state(spark: SparkSession) -> SparkSession:
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    return spark


def end_of_input(spark: SparkSession, schema: T.StructType, at: Any, column: str = "ts") -> DataFrame:
    """One row with empty texts and a time: it matches no rule, and moves the watermark.

    Texts are empty, not null: a join drops null keys in front of the watermark.
    """

    def value(f: T.StructField) -> Column:
        text = "" if isinstance(f.dataType, T.StringType) else None
        return F.lit(at if f.name == column else text).cast(f.dataType).alias(f.name)

    return spark.range(1).select(*[value(f) for f in schema])


def _behind_watermark(df: DataFrame, condition: Column, watermark: str) -> DataFrame:
    """Rows that meet a condition; the others count for the watermark as well.

    A condition that does not name the event time would be moved in front of the watermark.
    """
    never = F.col("ts") < F.timestamp_micros(F.lit(_BEFORE_TIME))
    return df.withWatermark("ts", watermark).where(condition | never)


class FirstCrossing(StatefulProcessor):
    """The first event of a group that completes ``threshold`` events within the window.

    Held per group: the events up to the earliest crossing seen so far, back to the window
    before the watermark and ``threshold - 1`` more. Without a crossing there are fewer than
    ``threshold`` events in any window, so these are few, however busy the group. An earlier
    crossing can still come until the watermark has passed the one that is known: a timer
    waits for that. A group that has fired keeps one mark: for ever, as the batch rule fires
    once, or for ``rearm_seconds`` of event time. A quiet group is forgotten one window after
    its last event.
    """

    def __init__(self, threshold: int, window_seconds: int, rearm_seconds: int | None = None):
        self.need, self.width = threshold - 1, window_seconds * 1_000_000
        self.rearm = rearm_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fired = handle.getValueState("fired", "t long")
        self.events = handle.getListState("events", "t long, event_seq long")

    def _held(self, chunks: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        """Held and new events in order, up to the earliest crossing."""
        held = list(self.events.get()) if self.events.exists() else []
        t, seq = (np.array([row[i] for row in held], np.int64) for i in range(2))
        for chunk in chunks:
            # chunks come in any order; rows after the earliest crossing so far are useless
            # until the group may fire again
            t = np.concatenate([t, chunk["t"].to_numpy()])
            seq = np.concatenate([seq, chunk["event_seq"].to_numpy()])
            order = np.lexsort((seq, t))
            t, seq = t[order], seq[order]
            end = self._crossing(t)
            if end is not None:
                useful = t > self._deaf_after(t[end])
                useful[: end + 1] = True
                t, seq = t[useful], seq[useful]
        return t, seq

    def _crossing(self, t: np.ndarray) -> int | None:
        if len(t) <= self.need:
            return None
        found = np.flatnonzero(t[self.need :] - t[: len(t) - self.need] <= self.width)
        return int(found[0]) + self.need if len(found) else None

    def _deaf_after(self, fired: int) -> int:
        """Time up to which events of a group that has fired do not count."""
        return _NO_TIME if self.rearm is None else int(fired) + self.rearm * 1_000_000

    def _settle(self, key: tuple, t: np.ndarray, seq: np.ndarray, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Fire if the watermark has passed the crossing, else keep what can still count."""
        watermark = watermark_ms * 1000
        timers = set()
        while (end := self._crossing(t)) is not None and t[end] <= watermark:
            self.fired.update((int(t[end]),))
            yield pd.DataFrame({"grp": [key[0]], "event_seq": [int(seq[end])], "t": [int(t[end])]})
            again = t > self._deaf_after(t[end])
            t, seq = t[again], seq[again]
        crossing = None if end is None else int(t[end])
        kept = slice(max(0, int(np.searchsorted(t, watermark - self.width)) - self.need), None)
        t, seq = t[kept], seq[kept]
        if len(t) and (crossing is not None or t[-1] + self.width >= watermark):
            self.events.put(list(zip(t.tolist(), seq.tolist())))
            # in milliseconds, rounded up
            timers.add(-(-(int(t[-1]) + self.width + 1 if crossing is None else crossing) // 1000))
        else:
            self.events.clear()
        if self.rearm is not None and self.fired.exists():
            deaf = self._deaf_after(self.fired.get()[0])
            if deaf < watermark:
                self.fired.clear()
            else:
                timers.add(deaf // 1000 + 1)
        timers = {max(at, watermark_ms + 1) for at in timers}
        known = set(self.handle.listTimers())
        for at in known - timers:
            self.handle.deleteTimer(at)
        for at in timers - known:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.fired.exists():
            if self.rearm is None:
                return
            deaf = self._deaf_after(self.fired.get()[0])
            rows = (chunk[chunk["t"] > deaf] for chunk in rows)
        yield from self._settle(key, *self._held(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, *self._held(iter(())), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_threshold(
    events: DataFrame, rule: ThresholdRule, watermark: str = "10 minutes", rearm_seconds: int | None = None
) -> DataFrame:
    """One row per group on its first crossing, once the watermark has passed it.

    The row is the one the batch rule gives for all events together, however they are
    shuffled over batches within the watermark; events before the watermark are dropped.
    ``rearm_seconds`` lets a group fire again that long after it fired.
    """
    configure_state(events.sparkSession)
    matching = _behind_watermark(events, rule.predicate(events), watermark).select(
        group_of(F.col(rule.group_by)).alias("grp"), "event_seq", micros(F.col("ts")).alias("t"), "ts"
    )
    return (
        matching.groupBy("grp")
        .transformWithStateInPandas(FirstCrossing(rule.threshold, rule.window_seconds, rearm_seconds), _ALERT, "append", "eventtime")
        .select("grp", "event_seq", F.timestamp_micros("t").alias("ts"))
    )


def _interval_micros(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.unix_micros(F.expr(f"timestamp_seconds(0) + interval {interval}"))).first()[0]


def stream_chains(
    events: DataFrame,
    alerts: DataFrame,
    window_seconds: int = 300,
    min_events: int = 2,
    watermark: str = "10 minutes",
    horizon: str = "1 day",
) -> DataFrame:
    """Sessions of suspicious events per alerted address, emitted when the watermark passes.

    An event is suspicious when an alert carries its key, or when its status was rejected and
    its address has an alert at most ``horizon`` away. Both are stream-stream semi joins: a
    rejected event waits for an alert no longer than the horizon, and alerts are kept no
    longer either. The alerts of an address are reduced to one row per cell of time first, so
    a busy address does not pair all its alerts with all its events. Two events share a
    session if they are at most the window apart.
    """
    events = events.withColumn("ip_group", group_of(F.col("ip")))
    rejected = F.coalesce(F.col("status_code").isin(SUSPICIOUS_STATUS), F.lit(False))
    alerts = alerts.withWatermark("ts", watermark)
    # one alert per key is enough, and alerts that repeat a key would each look at all its events
    keys = alerts.dropDuplicates(KEY_COLUMNS).select(*[F.col(c).alias(f"_{c}") for c in KEY_COLUMNS])
    same_key = [F.col(c) == F.col(f"_{c}") for c in KEY_COLUMNS]
    alerted = _behind_watermark(events, ~rejected, watermark).select("ip_group", *KEY_COLUMNS).join(keys, same_key, "left_semi")
    # of a cell narrower than the horizon, the first and last alert say whether any is near
    cell = max(1, _interval_micros(events.sparkSession, horizon) // _HORIZON_CELLS)
    about = (
        alerts.groupBy(F.col("ip_group").alias("_ip"), F.window("ts", f"{cell} microseconds").alias("_cell"))
        .agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
        .select("_ip", "_first", "_last", F.window_time("_cell").alias("_ts"))
    )
    near = F.expr(
        f"ip_group = _ip and _first <= ts + interval {horizon} and _last >= ts - interval {horizon} "
        f"and _ts between ts - interval {horizon} and ts + interval {horizon} + interval {cell} microseconds"
    )
    failed = _behind_watermark(events, rejected, watermark).select("ip_group", *KEY_COLUMNS).join(about, near, "left_semi")
    # a session ends where its gap does not reach: one microsecond more keeps events that are
    # exactly the window apart together
    gap = F.session_window("ts", f"{window_seconds} seconds 1 microsecond").alias("w")
    return (
        alerted.unionByName(failed)
        .groupBy(F.col("ip_group").alias("ip"), gap)
        .agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("event_count"))
        .where(F.col("event_count") >= min_events)
        .select("ip", "start_time", "end_time", "event_count")
    )
