"""State that changes by the clock: story lifecycles, quarantine, sessions of mentions (STR-01, -03, -04, -06).

Timers are event-time timers: they fire when the watermark passes them, so a story turns stale in a batch that has nothing of it.
Both processors need the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.memory import lifecycle
from ..sources.files import overwrite_partitions, read_table
from ..staging import staged, unstage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Quiet days after which a story is a follow-up, and stale; mentions from which it peaks, and develops (fixed values).
FOLLOW_UP_DAYS, STALE_DAYS, PEAK, DEVELOPING = 3, 7, 5, 2
STORY = "story_key string, state string, events int, last_seen timestamp, at timestamp"
HELD = "id string, status string, expires_at timestamp"


def _stamp(ms: int) -> pd.Timestamp:
    return pd.Timestamp(datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms)).tz_localize(None)


def _state(quiet: int, events: int) -> str:
    if quiet > STALE_DAYS:
        return "stale"
    if quiet > FOLLOW_UP_DAYS:
        return "follow-up"
    return "peak" if events >= PEAK else "developing" if events >= DEVELOPING else "emerging"


class Stories(StatefulProcessor):
    """A story's distinct events (map state), its last mention and state (value state), and the two midnights at which quiet changes it (timers)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.story = handle.getValueState("story", "last long, count int, state string")
        self.events = handle.getMapState("events", "event_id string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, count, state = self.story.get() if self.story.exists() else (None, 0, None)
        for pdf in rows:
            for event_id, at in pdf[["event_id", "ms"]].itertuples(index=False):
                if not self.events.containsKey((event_id,)):
                    self.events.updateValue((event_id,), (int(at),))
                    count += 1
                last = int(at) if last is None else max(last, int(at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        midnight = last // DAY_MS * DAY_MS
        for days in (FOLLOW_UP_DAYS, STALE_DAYS):
            self.handle.registerTimer(midnight + (days + 1) * DAY_MS)
        now = max(last, timerValues.getCurrentWatermarkInMs())
        new = _state((now // DAY_MS * DAY_MS - midnight) // DAY_MS, count)
        self.story.update((last, count, new))
        if new != state:
            yield self._row(key, new, count, last, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        last, count, state = self.story.get()
        new = _state((at - last // DAY_MS * DAY_MS) // DAY_MS, count)
        if new != state:
            self.story.update((last, count, new))
            yield self._row(key, new, count, last, at)

    @staticmethod
    def _row(key, state: str, count: int, last: int, at: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], state, count, _stamp(last), _stamp(at))], columns=["story_key", "state", "events", "last_seen", "at"])

    def close(self) -> None:
        pass


def stream_stories(mentions: DataFrame, late: str = "1 day") -> DataFrame:
    """A row each time that a story's state changes, by a mention or by the clock. mentions: story_key, event_id, at (timestamp)."""
    rows = mentions.where("story_key is not null and at is not null").withWatermark("at", late).select("story_key", F.coalesce("event_id", F.lit("")).alias("event_id"), F.unix_millis("at").alias("ms"), "at")
    return rows.groupBy("story_key").transformWithStateInPandas(Stories(), STORY, "Update", "EventTime")


def batch_stories(mentions: DataFrame, now: Column) -> DataFrame:
    """(story_key, state, events, last_seen) at a moment: where the stream stands when its watermark is now."""
    rows = mentions.where("story_key is not null and at is not null")
    stories = rows.groupBy("story_key").agg(F.count_distinct(F.coalesce("event_id", F.lit(""))).cast("int").alias("events"), F.max("at").alias("last_seen"))
    day = F.greatest(now, F.col("last_seen")).cast("date")
    return stories.select("story_key", lifecycle(F.col("last_seen").cast("date"), F.lit(None), F.col("events"), day).alias("state"), "events", "last_seen")


class Quarantine(StatefulProcessor):
    """A quarantined row until its time is over; a new report of the same id starts the time again."""

    def __init__(self, days: int = 3):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max(int(pdf["ms"].max()) for pdf in rows) + self.days * DAY_MS
        if self.held.exists():
            last = max(last, self.held.get()[0])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.held.update((last,))
        self.handle.registerTimer(last)
        yield pd.DataFrame([(key[0], "held", _stamp(last))], columns=["id", "status", "expires_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (at,) = self.held.get()
        self.held.clear()
        yield pd.DataFrame([(key[0], "expired", _stamp(at))], columns=["id", "status", "expires_at"])

    def close(self) -> None:
        pass


def stream_quarantine(noise: DataFrame, days: int = 3, late: str = "1 hour") -> DataFrame:
    """(id, status, expires_at): a row when an id is held, and one when its time is over. noise: id, at (timestamp)."""
    rows = noise.where("id is not null and at is not null").withWatermark("at", late).select("id", F.unix_millis("at").alias("ms"), "at")
    return rows.groupBy("id").transformWithStateInPandas(Quarantine(days), HELD, "Update", "EventTime")


#: Hours without a mention that end a session, by the source's tier (fixed values).
GAPS = {1: 6, 2: 12}
OTHER_GAP = 24


def gap(tier: Column, gaps: dict[int, int] = GAPS, other: int = OTHER_GAP) -> Column:
    """The session gap of a mention as text, as session_window takes it."""
    out = F.lit(f"{other} hours")
    for k, hours in gaps.items():
        out = F.when(tier == k, f"{hours} hours").otherwise(out)
    return out


def sessions(mentions: DataFrame, late: str | None = None) -> DataFrame:
    """(story_key, started, ended, mentions): bursts of a story's mentions. A mention holds its session open for its tier's gap. With late, mentions is a stream.

    mentions: story_key, at, tier. Rows without a time or story are in no session.
    """
    rows = mentions.where("story_key is not null and at is not null")
    if late is not None:
        rows = rows.withWatermark("at", late)
    window = F.session_window("at", gap(F.col("tier")))
    counted = rows.groupBy("story_key", window.alias("w")).agg(F.count("*").alias("mentions"))
    return counted.select("story_key", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "mentions")


def split_late(stream: DataFrame, on_time: str, late: str, checkpoint: str, delay_hours: float, time: str = "at", once: bool = False) -> StreamingQuery:
    """Write rows that come more than so many hours after the latest time of earlier batches to a table of their own, and the others to on_time.

    The latest time of each batch is kept beside on_time, so a batch that runs again splits as before; each batch replaces its own folder. A null time is on time.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = staged(df.withColumn("batch", F.lit(number).cast("long")), "mentions")
        clock = read_table(spark, f"{on_time}-clock", "latest timestamp, batch long")
        edge = clock.where(F.col("batch") < number).agg(F.max("latest").alias("latest"))  # one row
        marked = rows.crossJoin(F.broadcast(edge)).withColumn("_late", F.coalesce(F.col(time) < F.col("latest") - F.make_dt_interval(hours=F.lit(0), mins=F.lit(int(delay_hours * 60))), F.lit(False))).drop("latest")
        overwrite_partitions(marked.where("_late").drop("_late"), late, "batch")
        overwrite_partitions(marked.where("not _late").drop("_late"), on_time, "batch")
        overwrite_partitions(rows.agg(F.max(time).alias("latest")).withColumn("batch", F.lit(number).cast("long")), f"{on_time}-clock", "batch")
        unstage(rows)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
