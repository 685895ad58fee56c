"""Keyed state over rows in order of event time: rows wait until the watermark has passed them, timers drive the rest.

Rows of a stream may come in any order within the watermark. A key's rows wait in a list in the state store; its one timer
stands at the earliest of them. When the watermark passes the timer, the rows that are due go through ``follow`` in order
of time and id, so the result is that of a batch, whatever the order and the cuts of the micro-batches. When nothing waits,
the timer stands at the moment from which the key's value has no more meaning, and the key's state is removed there: state
follows the keys of the last ``watermark`` and of values that still count, not all keys ever seen. Late rows are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and lists need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Subclasses name the columns of a waiting row after event_id and at (microseconds), the value kept for a key, and
    ``follow``: (key, due rows, value or None) to (output columns, value or None, the moment at which the value ends)."""

    waiting = "event_id long, at long"
    value = "at long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.waiting)
        self.kept = handle.getValueState("kept", self.value)

    def follow(self, key: tuple, rows: list[tuple], value: tuple | None) -> tuple[pd.DataFrame | None, tuple | None, int]:
        raise NotImplementedError

    def _stand(self, at: int) -> None:
        """One timer, at the millisecond from which ``at`` is past."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.waiting.split(", ")]
        least = None
        for frame in rows:
            self.rows.appendList(list(frame[names].itertuples(index=False, name=None)))
            least = int(frame["at"].min()) if least is None else min(least, int(frame["at"].min()))
        timers = list(self.handle.listTimers())
        if least is not None and (not timers or -(-least // 1000) < min(timers)):
            self._stand(least)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(r) for r in self.rows.get()) if self.rows.exists() else []
        waiting.sort(key=lambda r: (r[1], r[0]))
        due = [r for r in waiting if -(-r[1] // 1000) <= now]
        value = tuple(self.kept.get()) if self.kept.exists() else None
        found, value, ends = self.follow(key, due, value)
        if value is not None and -(-ends // 1000) <= now:
            value = None  # from here on it changes nothing
        if due and len(due) < len(waiting):
            self.rows.put(waiting[len(due) :])
        elif due:
            self.rows.clear()
        if value is not None:
            self.kept.update(value)
        elif self.kept.exists():
            self.kept.clear()
        if len(due) < len(waiting):
            self._stand(waiting[len(due)][1])
        elif value is not None:
            self._stand(ends)
        if found is not None and len(found):
            yield found

    def close(self) -> None:
        pass


class CacheState(InOrder):
    """The value of a key is the moment of its last miss."""

    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def follow(self, key: tuple, rows: list[tuple], value: tuple | None) -> tuple[pd.DataFrame | None, tuple | None, int]:
        missed, outcome = value[0] if value else None, []
        for _, at in rows:
            hit = missed is not None and at < missed + self.span
            missed = missed if hit else at
            outcome.append("hit" if hit else "miss")
        found = pd.DataFrame({"event_id": [r[0] for r in rows], "key": key[0], "outcome": outcome})
        return found, None if missed is None else (missed,), (missed or 0) + self.span


class CooldownState(InOrder):
    """The value of an account is the local day and the end of its latest cooldown; a new local day begins without one."""

    waiting = "event_id long, at long, action string, day int, until long, midnight long"
    value = "day int, until long, midnight long"

    def follow(self, key: tuple, rows: list[tuple], value: tuple | None) -> tuple[pd.DataFrame | None, tuple | None, int]:
        hits = []
        for event_id, at, action, day, until, midnight in rows:
            if value is not None and value[0] != day:
                value = None
            if action == "download" and value is not None and at < value[1]:
                hits.append(event_id)
            if action == "rate_limited":
                value = (day, until, midnight)
        return pd.DataFrame({"event_id": hits, "account": [key[0]] * len(hits)}), value, min(value[1:]) if value else 0


def cache_outcomes_stream(requests: DataFrame, seconds: int = 3600, watermark: str = "10 minutes") -> DataFrame:
    """ST5: (event_id, key, outcome) of requests that the watermark has passed; keys are removed when their last miss ends."""
    rows = requests.filter("key is not null").withWatermark("ts", watermark).select("event_id", "key", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(CacheState(seconds), "event_id long, key string, outcome string", "Append", "EventTime")


def cooldown_stream(events: DataFrame, watermark: str = "10 minutes", zone: str = "Asia/Taipei") -> DataFrame:
    """ST6: (event_id, account): downloads that an account tries while it cools down, once the watermark has passed them; an
    account is removed at the end of its cooldown or at local midnight, whichever is first."""
    at, day = F.unix_micros("ts"), F.to_date(F.from_utc_timestamp("ts", zone))
    rows = events.filter(F.col("action").isin("download", "rate_limited")).withWatermark("ts", watermark)
    midnight = F.unix_micros(F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone))
    rows = rows.select("event_id", "account", "action", "ts", at.alias("at"), F.unix_date(day).alias("day"), (at + (F.col("amount") % 60) * 60_000_000).alias("until"), midnight.alias("midnight"))
    return rows.groupBy("account").transformWithStateInPandas(CooldownState(), "event_id long, account long", "Append", "EventTime")
