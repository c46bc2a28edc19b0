"""Alerts from a stream of readings: silent meters and stuck ones.

Each entity has a keyed state: the last reading that was judged, the run of equal
values it ends, and the readings that the watermark has not passed yet, many to
an entry. Readings are judged in the order of their times, whatever order they
came in: a timer at the end of the earliest hour that waits, or where a silence
would become an alert, calls for what the watermark has passed and sets the next.
Every call to the state takes a message to the JVM, so there are a few of them
per entity and batch, however many readings and hours it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice
from math import nan

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import reading
from .readings import END, event_time, is_reading

_HOUR_MS = 3_600_000
#: Readings of one entry of the state, and entries of one message.
_PACK, _AT_ONCE = 8192, 512
#: The summary of an entity of which nothing was judged.
_NEW = (None, False, None, None, 0)
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Within it, streams start on the state store that keyed states need. A stream
    keeps the settings of its start, so the session's own are put back."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _hour_end(t: int) -> int:
    """When the hour of ``t`` is over, in milliseconds."""
    return (t // (1000 * _HOUR_MS) + 1) * _HOUR_MS


class MeterWatch(StatefulProcessor):
    """``silence_ms`` without a reading is a gap; ``stuck`` equal values in a row make
    a stuck meter, announced once per run."""

    def __init__(self, silence_ms: int, stuck: int) -> None:
        self.silence, self.stuck = silence_ms * 1000, stuck

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One list, so that one message brings all of it. Its first entry, once a reading
        # was judged, is the summary, with times in microseconds; ``told``: the silence
        # after ``last`` is known already. The others are packed times and readings, NaN
        # for a missing one.
        self.state = handle.getListState("state", "last long, told boolean, value double, since long, n long, times binary, readings binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        while some := [(r.t, nan if r.v is None else r.v) for r in islice(rows, _PACK)]:
            times, readings = zip(*some)
            self.state.appendValue((*_NEW, np.array(times, "<i8").tobytes(), np.array(readings, "<f8").tobytes()))
            first = min(times if first is None else (first, *times))
        if first is not None:
            self.handle.registerTimer(_hour_end(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.state.get())
        before = _NEW if not held or held[0][5] is not None else held.pop(0)[:5]
        last, told, value, since, n = before
        times = np.frombuffer(b"".join(h[5] for h in held), "<i8")
        readings = np.frombuffer(b"".join(h[6] for h in held), "<f8")
        due = times <= passed
        t_due, v_due, times, readings = times[due], readings[due], times[~due], readings[~due]
        # By time, missing values first.
        order = np.lexsort((v_due, ~np.isnan(v_due), t_due))
        for k in range(0, len(order), _PACK):
            some = order[k : k + _PACK]
            for t, v in zip(t_due[some].tolist(), v_due[some].tolist()):
                if last is not None and t - last > self.silence and not told:
                    yield Row(entity=key[0], kind="gap", at=last + self.silence, since=last, n=None)
                last, told = t, False
                if v != v:
                    continue
                value, since, n = (value, since, n + 1) if n and v == value else (v, t, 1)
                if n == self.stuck:
                    yield Row(entity=key[0], kind="stuck", at=t, since=since, n=n)
        # One timer is enough: it asks for the next.
        wanted = [_hour_end(int(times.min()))] if len(times) else []
        if last is not None and not told:
            if last + self.silence <= passed:
                yield Row(entity=key[0], kind="gap", at=last + self.silence, since=last, n=None)
                told = True
            else:
                wanted.append((last + self.silence) // 1000 + 1)
        if wanted:
            self.handle.registerTimer(min(wanted))
        if len(order) or told != before[1]:
            packs = [(*_NEW, times[k : k + _PACK].tobytes(), readings[k : k + _PACK].tobytes()) for k in range(0, len(times), _PACK)]
            self.state.put([(last, told, value, since, n, None, None), *packs[:_AT_ONCE]])
            for k in range(_AT_ONCE, len(packs), _AT_ONCE):
                self.state.appendList(packs[k : k + _AT_ONCE])

    def close(self) -> None:
        pass


def stream_alerts(
    df: DataFrame, silence: str = "48 hours", stuck: int = 6, delay: str = "1 day", entity: str = "entity", ts: str = "ts", value: str = "value"
) -> DataFrame:
    """``entity``, ``kind``, ``ts``, ``since`` and ``n`` of each alert, once.

    ``gap``: no reading for longer than ``silence`` after ``since``; ``ts`` is when that
    became so. It is told when the watermark has passed ``ts``, without waiting
    for another reading. ``stuck``: ``n`` equal values in a row, from ``since`` to
    ``ts``; readings without a value do not end a run, and equal times go by value.
    Rows without a time, and rows that come later than ``delay`` allows, are left out.
    Start the stream within ``keyed_state``.
    """
    some = event_time(df, ts).withWatermark(ts, delay)
    some = some.filter(is_reading(df, ts)).select(F.col(entity).alias("entity"), F.col(ts).alias("_ts"), F.unix_micros(ts).alias("t"), reading(value).alias("v"))
    some = some.filter("t is not null")
    milliseconds = int(pd.Timedelta(silence).total_seconds() * 1000)
    kind = some.schema["entity"].dataType.simpleString()
    found = some.groupBy("entity").transformWithState(
        MeterWatch(milliseconds, stuck), f"entity {kind}, kind string, at long, since long, n long", "Append", "EventTime"
    )
    return found.select(F.col("entity").alias(entity), "kind", F.timestamp_micros("at").alias(ts), F.timestamp_micros("since").alias("since"), "n")
