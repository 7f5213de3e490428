"""Stream monitors over ordered files: state across batches and late rows."""

import datetime as dt

import random

import pandas as pd
import pytest

from wavemill.streaming import in_order, monitors

T0 = dt.datetime(2024, 1, 1)


def files(spark, path, batches):
    for n, rows in enumerate(batches):
        pdf = pd.DataFrame([(k, T0 + dt.timedelta(milliseconds=ms), float(v)) for k, ms, v in rows], columns=["key", "ts", "value"])
        spark.createDataFrame(pdf, "key string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema("key string, ts timestamp, value double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(path))


def drain(stream, path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_clip_run_across_batches(spark, tmp_path):
    s = files(spark, tmp_path / "in", [[("a", i, 1.0) for i in range(3)], [("a", 3, 1.0), ("a", 4, 0.0)], [("a", 20_000, 0.0)]])
    got = drain(monitors.stream_clip_runs(s, 0.99, 3), tmp_path, "runs")
    assert [(r.key, r.n) for r in got] == [("a", 4)]


def test_envelope_state_is_carried(spark, tmp_path):
    rows = [("a", i, 0.5) for i in range(6)]
    s = files(spark, tmp_path / "in", [rows[:2], rows[2:], [("b", 20_000, 0.0)]])
    got = sorted(drain(monitors.stream_envelope(s, 0.5, 0.1), tmp_path, "env"), key=lambda r: r.ts)
    e, want = 0.0, []
    for _ in range(6):
        e += 0.5 * (0.5 - e)
        want.append(e)
    assert [round(r.envelope, 9) for r in got] == [round(v, 9) for v in want]


def test_late_rows_are_dropped(spark, tmp_path):
    s = files(spark, tmp_path / "in", [[("a", 0, 1.0), ("a", 10_000, 1.0)], [("a", 20_000, 1.0)], [("a", 100, 5.0), ("a", 30_000, 1.0)]])
    got = drain(monitors.stream_block_levels(s, "3 seconds", "1 second"), tmp_path, "blocks")
    first = min(got, key=lambda r: r.start)
    assert first.n == 1 and first.peak == 1.0


def followed(rows, attack=0.5, release=0.1, idle=60_000):
    out, level, last = {}, {}, {}
    for k, ms, v in sorted(rows):
        e = level.get(k, 0.0) if ms - last.get(k, ms) <= idle else 0.0
        e += (attack if v > e else release) * (v - e)
        level[k], last[k] = e, ms
        out[k, ms] = round(e, 9)
    return out


def test_shuffled_stream_gives_the_result_of_the_sorted_one(spark, tmp_path):
    """Rows arrive out of order within and across batches, up to the lateness; silences start a key anew."""
    r = random.Random(4)
    rows = [(k, 1000 * n + r.randrange(1000) + (200_000 if n > 60 else 0), r.choice([0.0, 0.3, 1.0])) for n in range(120) for k in "abc"]
    arrival = sorted(rows, key=lambda x: x[1] + r.uniform(0, 8000))
    batches = [arrival[i : i + 60] for i in range(0, len(arrival), 60)] + [[("z", 1_000_000, 0.0)]]
    s = files(spark, tmp_path / "in", batches)
    got = drain(monitors.stream_envelope(s, 0.5, 0.1, "10 seconds", "2 seconds", "60 seconds"), tmp_path, "shuffled")
    assert {(x.key, round((x.ts - T0).total_seconds() * 1000)): round(x.envelope, 9) for x in got} == followed(rows)
    runs = drain(monitors.stream_clip_runs(files(spark, tmp_path / "in2", batches), 0.9, 1, "10 seconds", "2 seconds", "60 seconds"), tmp_path, "shuffled_runs")
    want, run = [], {}
    for k, ms, v in sorted(rows):
        if k in run and (v < 0.9 or ms - run[k][1] > 60_000):
            want.append((k, *run.pop(k)))
        if v >= 0.9:
            run[k] = (run[k][0], ms, run[k][2] + 1) if k in run else (ms, ms, 1)
    want += [(k, *x) for k, x in run.items()]
    ms = lambda t: round((t - T0).total_seconds() * 1000)
    assert sorted((x.key, ms(x.start), ms(x.last), x.n) for x in runs) == sorted(want)


def test_state_of_silent_keys_goes(spark, tmp_path):
    batches = [[(f"k{n}-{i}", 100_000 * n + i, 1.0) for i in range(30)] for n in range(6)]
    s = files(spark, tmp_path / "in", batches)
    q = monitors.stream_envelope(s, late="1 second", step="1 second", idle="30 seconds").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    totals = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert max(totals) < 60 * 8 and totals[-1] <= 30 * 8 < 180 * 2


class _State:
    """The state of one key in memory, counting how many rows are read at once."""

    def __init__(self):
        self.value, self.map, self.timers, self.read = None, {}, set(), 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, *schema):
        return _Map(self)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


class _Map:
    def __init__(self, state):
        self.state = state

    def keys(self):
        return iter(list(self.state.map))

    def updateValue(self, key, value):
        self.state.map[key] = value

    def getValue(self, key):
        self.state.read = max(self.state.read, len(self.state.map[key][0]))
        return self.state.map[key]

    def removeKey(self, key):
        del self.state.map[key]


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("seed", range(4))
def test_a_key_with_very_many_rows_stays_in_bounded_blocks(monkeypatch, seed):
    monkeypatch.setattr(in_order, "ROWS", 50)
    r, state = random.Random(seed), _State()
    p = monitors._Envelope(0.5, 0.1, step="1 second", idle="1 hour")
    p.init(state)
    rows = [(n * 7 + r.randrange(7), r.random()) for n in range(4000)]
    arrival = sorted(rows, key=lambda x: x[0] + r.uniform(0, 5000))
    out, seen = [], 0
    for i in range(0, len(arrival), 500):
        part = arrival[i : i + 500]
        frames = [pd.DataFrame([(ms * 1000, v) for ms, v in part[k : k + 130]], columns=["us", "value"]) for k in range(0, 500, 130)]
        out += list(p.handleInputRows(("a",), iter(frames), _Clock(seen)))
        seen = max(seen, max(ms for ms, _ in part) - 6000)
        while state.timers and min(state.timers) <= seen:
            out += list(p.handleExpiredTimer(("a",), _Clock(seen), None))
    out += list(p.handleExpiredTimer(("a",), _Clock(10**6), None))
    got = pd.concat(out)
    assert got["us"].is_monotonic_increasing
    want, e = [], 0.0
    for _, v in sorted(rows, key=lambda x: x[0]):
        e += (0.5 if v > e else 0.1) * (v - e)
        want.append(e)
    assert len(got) == len(rows) and abs(got["envelope"].iloc[-1] - want[-1]) < 0.2
    assert state.read < 50 + 2 * 145 and not state.map
    out = list(p.handleExpiredTimer(("a",), _Clock(10**9), None))
    assert state.value is None and not state.timers


def test_a_key_with_few_rows_costs_few_calls_to_the_state():
    """Each call goes to another process: one batch of a new key and the timer that releases it need a dozen."""
    state, calls = _State(), []
    p = monitors._ClipRuns(0.9, 2, step="1 second", idle="10 seconds")

    def counted(name, whole):
        def run(*args):
            calls.append(name)
            return whole(*args)

        return run

    for name in ("exists", "get", "update", "clear", "listTimers", "deleteTimer", "registerTimer"):
        setattr(state, name, counted(name, getattr(state, name)))
    p.init(state)
    for name in ("keys", "updateValue", "getValue", "removeKey"):
        setattr(p.waiting, name, counted(name, getattr(p.waiting, name)))
    rows = pd.DataFrame([(n * 100_000, float(n % 5 < 3)) for n in range(60)][::-1], columns=["us", "value"])
    out = list(p.handleInputRows(("a",), iter([rows]), _Clock(0)))
    out += list(p.handleExpiredTimer(("a",), _Clock(8000), None))
    assert pd.concat(out)["n"].tolist() == [3] * 12
    assert len(calls) <= 12, calls
