"""Locks and cadence of operations as state of a stream (PR18, CO1, AG27).

Events are (op, kind, ts): `lock` when an operation takes its lock, `ok` when
a run ends well, any other kind just moves time on.  The stream gives the
changes (op, at, aspect, value), each at the time it holds from, not when it
was noticed:

    lock      held at the event, stale 30 minutes later
    cooldown  cooling at the event, over 24 hours later
    cadence   ran at the event, due once more than 14 days have passed

A change that comes with time alone is an event-time timer, so it comes out
when the watermark has passed it, or before the next event of its operation
that is later.  State is three times an operation.  Events may come in any
order within the watermark's delay; an older event than one seen changes
nothing that holds now.

`states` sums the changes up to a time; they are then what the batch functions
say of the same events.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import CADENCE_DAYS

CHANGES = "op string, at timestamp, aspect string, value string"
#: aspect: (kind of event that starts it, value then, value later)
ASPECTS = {"lock": ("lock", "held", "stale"), "cooldown": ("ok", "cooling", "over"), "cadence": ("ok", "ran", "due")}
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _micros(at: datetime) -> int:
    """Microseconds since 1970; times without a zone are the session's, UTC."""
    at = at if at.tzinfo else at.astimezone()
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


class Lease(StatefulProcessor):
    """The last event of each kind, and what follows from it with time."""

    def __init__(self, held_minutes: int = 30, cooldown_hours: int = 24, cadence_days: int = CADENCE_DAYS) -> None:
        self.after = {"lock": held_minutes * 60_000_000, "cooldown": cooldown_hours * 3_600_000_000, "cadence": cadence_days * 86_400_000_000}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # when each aspect began, and whether what comes with time has come
        self.state = handle.getValueState("aspects", ", ".join(f"{a}_at long, {a}_done boolean" for a in ASPECTS))

    def _load(self) -> dict[str, Any]:
        if self.state.exists():
            now = self.state.get()
            return {f"{a}_{p}": now[2 * i + j] for i, a in enumerate(ASPECTS) for j, p in enumerate(("at", "done"))}
        return {f"{a}_{p}": None for a in ASPECTS for p in ("at", "done")}

    def _later(self, aspect: str, began: int) -> int:
        """When an aspect's second value begins; the cadence is counted in days of the calendar."""
        if aspect == "cadence":
            day = 86_400_000_000
            return (began // day) * day + self.after[aspect] + day
        return began + self.after[aspect]

    def _expired(self, key: Any, now: dict[str, Any], until: int) -> Iterator[Row]:
        for aspect, (_, _, value) in ASPECTS.items():
            began = now[f"{aspect}_at"]
            if began is not None and not now[f"{aspect}_done"] and self._later(aspect, began) <= until:
                now[f"{aspect}_done"] = True
                yield self._row(key, self._later(aspect, began), aspect, value)

    @staticmethod
    def _row(key: Any, micros: int, aspect: str, value: str) -> Row:
        return Row(op=key[0], at=datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=micros), aspect=aspect, value=value)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = self._load()
        for at, kind in sorted((_micros(r["ts"]), r["kind"] or "") for r in rows):
            yield from self._expired(key, now, at)
            for aspect, (starts, value, _) in ASPECTS.items():
                if kind == starts and (now[f"{aspect}_at"] is None or at > now[f"{aspect}_at"]):
                    now[f"{aspect}_at"], now[f"{aspect}_done"] = at, False
                    yield self._row(key, at, aspect, value)
                    # a millisecond up, as timers have no finer time
                    self.handle.registerTimer(-(-self._later(aspect, at) // 1000))
        self.state.update(tuple(now.values()))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = self._load()
        changes = list(self._expired(key, now, expiredTimerInfo.getExpiryTimeInMs() * 1000))
        if changes:
            self.state.update(tuple(now.values()))
        yield from changes

    def close(self) -> None:
        pass


def changes(events: DataFrame, *, late: str = "1 hour", held_minutes: int = 30, cooldown_hours: int = 24, cadence_days: int = CADENCE_DAYS) -> DataFrame:
    """The changes of a stream of events; the session needs the settings in STORE."""
    rows = events.select(F.col("op").cast("string").alias("op"), "kind", "ts").filter("op is not null and ts is not null").withWatermark("ts", late)
    return rows.groupBy("op").transformWithState(Lease(held_minutes, cooldown_hours, cadence_days), CHANGES, "Append", "EventTime")


def states(found: DataFrame, as_of: Column) -> DataFrame:
    """(op, state, cooling_down, due) as of a time, from the changes until then; null where there was no run."""
    last = lambda aspect: F.max_by(F.when(F.col("aspect") == aspect, F.col("value")), F.when(F.col("aspect") == aspect, F.struct("at", F.col("value").isin(*[v[2] for v in ASPECTS.values()]))))
    now = found.filter(F.col("at") <= as_of).groupBy("op").agg(*[last(a).alias(a) for a in ASPECTS])
    return now.select("op", F.coalesce("lock", F.lit("free")).alias("state"), F.coalesce(F.col("cooldown") == "cooling", F.lit(False)).alias("cooling_down"), (F.col("cadence") == "due").alias("due"))
