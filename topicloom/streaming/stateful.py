"""The issue log as streams that keep a state for each issue, with event-time timers: attempts time out, and resolved issues leave the state.

Both read events(event_id, issue_id, action, created_at) with a watermark on created_at, as issues.read_events() gives them, and need the RocksDB state store (`rocksdb()`). Events without a time are left out; a null issue is an
issue of its own; events later than the watermark are dropped by Spark, and by that alone does a stream differ from its batch twin. Times go in and out as microseconds, so the session's time zone plays no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from topicloom.streaming.issues import EDITS, RETRY_SECONDS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What makes an attempt due at once, and what has to be answered in time.
AT_ONCE, WAITING = ("pending", "failed"), "sending"
CLOSED, KEEP_DAYS = ("resolved",), 30


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _timed(events: DataFrame) -> DataFrame:
    return events.where("created_at is not null").select("issue_id", "event_id", "action", "created_at", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))


class _Retries(StatefulProcessor):
    """Of each issue, the events of the last minute before the watermark and those after it. One timer stands at the first attempt's end; when it fires, all attempts that end by the watermark are decided, in order."""

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at bigint, event_id bigint, action string")

    def _wake(self, first: int) -> None:
        """Have the timer at the first end, in whole milliseconds past it."""
        due = (first + self.micros) // 1000 + 1
        timers = list(self.handle.listTimers())
        if not timers or due < timers[0]:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for batch in rows:
            self.recent.appendList(list(batch[["at", "event_id", "action"]].itertuples(index=False, name=None)))
            at = int(batch["at"].min())
            first = at if first is None else min(first, at)
            now = batch[batch["action"].isin(AT_ONCE)]
            if len(now):
                yield pd.DataFrame({"event_id": now["event_id"], "issue_id": key[0], "reason": now["action"], "due": now["at"]})
        if first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(self.recent.get(), key=lambda e: (e[0], e[1]))
        ended = [i for i, (at, _, action) in enumerate(events) if action == WAITING and at + self.micros < mark]
        lost = [events[i] for i in ended if i + 1 == len(events) or events[i + 1][0] > events[i][0] + self.micros]
        left = [e for e in events if e[0] + self.micros >= mark]
        if left:
            self.recent.put(left)
            self._wake(left[0][0])
        else:
            self.recent.clear()
        if lost:
            yield pd.DataFrame({"event_id": [e[1] for e in lost], "issue_id": key[0], "reason": "timeout", "due": [e[0] + self.micros for e in lost]})


def retry_stream(events: DataFrame, seconds: int = RETRY_SECONDS) -> DataFrame:
    """(event_id, issue_id, reason, due_at): what has to be sent again, as soon as that is known. What is pending or has failed is due at its time; what is sending is due after a minute in which its issue had no later event."""
    schema = "event_id bigint, issue_id string, reason string, due bigint"
    out = _timed(events).groupBy("issue_id").transformWithStateInPandas(_Retries(seconds), schema, "Append", "EventTime")
    return out.select("event_id", "issue_id", "reason", F.timestamp_micros("due").alias("due_at"))


def retries(events: DataFrame, seconds: int = RETRY_SECONDS) -> DataFrame:
    """The batch twin of retry_stream()."""
    after = F.lead("at").over(Window.partitionBy("issue_id").orderBy("at", "event_id"))
    end = F.col("at") + seconds * 1_000_000
    lost = (F.col("action") == WAITING) & (F.col("_next").isNull() | (F.col("_next") > end))
    due = F.when(F.col("action").isin(*AT_ONCE), F.col("at")).when(lost, end)
    reason = F.when(F.col("action") == WAITING, "timeout").otherwise(F.col("action"))
    return _timed(events).withColumn("_next", after).withColumn("_due", due).where("_due is not null").select("event_id", "issue_id", reason.alias("reason"), F.timestamp_micros("_due").alias("due_at"))


_SPELL = ["spell", "status", "updated", "last_event_id", "n_events", "edits", "opened"]


class _Issues(StatefulProcessor):
    """Of each issue that is open or was closed of late, its state. A spell is numbered by the watermark at its first event, which a batch that runs again finds the same."""

    def __init__(self, edits: tuple[str, ...], closed: tuple[str, ...], keep_ms: int):
        self.edits, self.closed, self.keep_ms = edits, closed, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("issue", "spell bigint, status string, updated bigint, last_event_id bigint, n_events bigint, edits bigint, opened bigint")

    def _row(self, key, state, gone: bool) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *state, gone]], columns=["issue_id", *_SPELL, "gone"])

    def handleInputRows(self, key, rows, timerValues):
        now = self.state.get() if self.state.exists() else None
        for batch in rows:
            late = batch[batch["at"] == batch["at"].max()]
            last = late.loc[late["event_id"].idxmax()]
            mine = (int(last["at"]), int(last["event_id"]), last["action"])
            n, edits, opened = len(batch), int(batch["action"].isin(self.edits).sum()), int(batch["at"].min())
            if now is None:
                now = (timerValues.getCurrentWatermarkInMs(), mine[2], *mine[:2], n, edits, opened)
            else:
                at, event, status = mine if mine[:2] > (now[2], now[3]) else (now[2], now[3], now[1])
                now = (now[0], status, at, event, now[4] + n, now[5] + edits, min(now[6], opened))
        if now is None:
            return
        self.state.update(now)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if now[1] in self.closed:
            self.handle.registerTimer(now[2] // 1000 + 1 + self.keep_ms)
        yield self._row(key, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            yield self._row(key, self.state.get(), True)
            self.state.clear()


def state_stream(events: DataFrame, edits: tuple[str, ...] = EDITS, closed: tuple[str, ...] = CLOSED, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Each issue's state whenever events change it, and once more (`gone`) when it leaves: an issue that is closed and has had no event for `keep_days`. An event after that begins a new spell; current_state() adds spells up."""
    schema = "issue_id string, spell bigint, status string, updated bigint, last_event_id bigint, n_events bigint, edits bigint, opened bigint, gone boolean"
    keyed = _timed(events).groupBy("issue_id")
    return keyed.transformWithStateInPandas(_Issues(edits, closed, keep_days * 86_400_000), schema, "Append", "EventTime")


def current_state(written: DataFrame) -> DataFrame:
    """Rows of state_stream(), repeated ones too, as issues.state() over all events: of each spell its fullest row, and the spells of an issue together."""
    spell = written.groupBy("issue_id", "spell").agg(F.max_by(F.struct(*_SPELL[1:]), "n_events").alias("s")).select("issue_id", "s.*")
    last = F.max_by(F.struct("status", "updated", "last_event_id"), F.struct("updated", "last_event_id"))
    own = spell.groupBy("issue_id").agg(last.alias("s"), F.sum("n_events").alias("n_events"), (F.sum("edits") + 1).alias("version"), F.min("opened").alias("opened"))
    return own.select("issue_id", "s.status", F.timestamp_micros("s.updated").alias("updated_at"), "s.last_event_id", "n_events", "version", F.timestamp_micros("opened").alias("opened_at"))
