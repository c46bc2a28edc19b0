"""Streams that stop, go on from their checkpoint, and end."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import TimerValues

from wattframe.streaming import readings as st
from wattframe.streaming.alerts import MeterWatch, keyed_state, stream_alerts

SCHEMA = "entity string, ts timestamp_ntz, value double, meter string"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


@pytest.fixture
def arrive(spark, tmp_path):
    """Files arrive one after the other; a stream reads what is new."""

    def put(rows):
        data = [(e, at(h), v, m) for e, h, v, m in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return put


def started(spark, tmp_path, make):
    source = st.read_stream(spark, str(tmp_path / "in"), SCHEMA)
    whole = make(st.with_end(source, str(tmp_path / "ends")))
    out = str(tmp_path / "out")

    def run():
        progress = st.run_once(whole, out, str(tmp_path / "state"))
        return progress, [tuple(r) for r in spark.read.schema(whole.schema).parquet(out).collect()]

    return source, run


def test_last_bins_come_out_without_a_second_read(spark, tmp_path, arrive):
    arrive([("a", 0, 1.0, None), ("a", 1, 2.0, "y"), ("a", 2, None, "x"), (None, 1, 5.0, "n"), ("b", 1, None, "z")])
    source, run = started(spark, tmp_path, lambda s: st.stream_resample(s, "3H", "2 hours"))
    assert run()[1] == []
    arrive([("a", 30, 4.0, "x"), ("b", 2, 9.0, "late")])
    progress, rows = run()
    assert {(r[0], r[2], r[3]) for r in rows} == {("a", 1.5, "y"), (None, 5.0, "n"), ("b", 9.0, "z")}
    st.mark_end(spark, str(tmp_path / "ends"), source.schema, "2100-01-01")
    progress, rows = run()
    # The run that ends reads the marker, and none of the rows again.
    assert sum(p["numInputRows"] for p in progress) == 1
    assert {(r[0], r[1].replace(tzinfo=None), r[2], r[3]) for r in rows if r[0] == "a"} == {("a", at(0), 1.5, "y"), ("a", at(30), 4.0, "x")}
    assert len(rows) == 4 and run()[1] == rows


def test_alerts_over_restarts(spark, tmp_path, arrive):
    make = lambda s: stream_alerts(s, "10 hours", 3, "5 hours")
    with keyed_state(spark):
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        # Out of order within the delay; a missing value does not end a run.
        arrive([("a", 2, 7.0, None), ("a", 0, 7.0, None), ("a", 1, None, None), ("n", 0, 1.0, None), (None, 3, 2.0, None)])
        source, run = started(spark, tmp_path, make)
        assert run()[1] == []
        arrive([("a", 3, 7.0, None), ("a", 4, 7.0, None), ("b", 12, 1.0, None)])
        shown = lambda rows: sorted(((r[0], r[1], r[2].replace(tzinfo=None), r[3].replace(tzinfo=None), r[4]) for r in rows), key=str)
        stuck = ("a", "stuck", at(3), at(0), 3)
        assert shown(run()[1]) == [stuck]
        # No reading of "n" since 0: known once the watermark is past 10.
        arrive([("b", 16, 2.0, None), ("a", 0, 7.0, None)])
        silent = ("n", "gap", at(10), at(0), None)
        assert shown(run()[1]) == sorted([stuck, silent], key=str)
        assert shown(run()[1]) == sorted([stuck, silent], key=str)
        # "a" is silent for just ten hours, which is not longer.
        # "n" comes back: no second alert for the same silence, and a new one for the next.
        arrive([("n", 17, 1.0, None), ("n", 40, 1.0, None), ("b", 20, 5.0, None), ("a", 14, 7.0, None)])
        run()
        st.mark_end(spark, str(tmp_path / "ends"), source.schema, at(60))
        rows = shown(run()[1])
        gaps = {(e, since) for e, kind, _, since, _ in rows if kind == "gap"}
        assert gaps == {("n", at(0)), ("n", at(17)), ("n", at(40)), ("a", at(14)), (None, at(3)), ("b", at(20))}
        assert len([r for r in rows if r[1] == "gap"]) == len(gaps) and [r for r in rows if r[1] == "stuck"][0] == stuck
        assert shown(run()[1]) == rows
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


class Held:
    """A list state and timers in memory that count the calls."""

    def __init__(self):
        self.calls, self.entries, self.timers = 0, [], set()

    def getListState(self, name, schema):
        return self

    def called(self):
        self.calls += 1

    def get(self):
        self.called()
        return iter(self.entries)

    def appendValue(self, entry):
        self.called()
        self.entries.append(entry)

    def appendList(self, entries):
        self.called()
        self.entries.extend(entries)

    def put(self, entries):
        self.called()
        self.entries = list(entries)

    def registerTimer(self, at):
        self.called()
        self.timers.add(at)


def test_calls_to_the_state_do_not_grow_with_hours():
    hour, held, watch = 3_600_000_000, Held(), MeterWatch(10 * 3_600_000, 3)
    watch.init(held)
    # One reading an hour, backwards, with a silence after 400; more than one entry.
    times = [h * hour for h in range(20_000) if not 400 < h < 420]
    assert not list(watch.handleInputRows(("a",), iter(Row(t=t, v=None if t == hour else float(t > 500 * hour)) for t in reversed(times)), None))
    assert held.calls <= 4 and held.timers == {3_600_000}
    alerts = []
    for passed in (300 * hour, 19_000 * hour, 30_000 * hour):
        held.timers = {t for t in held.timers if t >= passed // 1000}
        before = held.calls
        alerts += [tuple(r) for r in watch.handleExpiredTimer(("a",), TimerValues(0, passed // 1000), None)]
        assert held.calls - before <= 3
    assert alerts == [
        ("a", "stuck", 3 * hour, 0, 3), ("a", "gap", 410 * hour, 400 * hour, None), ("a", "stuck", 503 * hour, 501 * hour, 3),
        ("a", "gap", 20_009 * hour, 19_999 * hour, None),
    ]
    assert not held.timers and len(held.entries) == 1
