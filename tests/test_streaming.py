"""Stateful streaming functions against plain replays, with the state cut at every batch, and sinks that are run twice."""

import datetime as dt
import random

import pandas as pd
import pytest

from petrichor.streaming import streams as SM


class State:
    def __init__(self):
        self.value, self.exists, self.mark, self.wake = None, False, 0, None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value, self.exists = v, True

    def remove(self):
        self.value, self.exists, self.wake = None, False, None

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, ms):
        assert ms > self.mark
        self.wake = ms


def stream(fn, batches, frame, time, delay_ms, row):
    """Batches, each followed by the call of a timer that the watermark has passed; late rows are dropped as Spark does."""
    state, out, newest = State(), [], 0
    for b in [*batches, []]:
        rows = [x for x in b if time(x) >= state.mark]
        if rows:
            out += [row(o) for pdf in fn(("d",), iter([frame(rows)]), state) for o in pdf.itertuples(index=False)]
        newest = max([newest, *(time(x) for x in b)])
        state.mark = max(state.mark, newest - delay_ms)
        if state.exists and state.wake < state.mark:
            out += [row(o) for pdf in fn(("d",), iter([]), state) for o in pdf.itertuples(index=False)]
    return out, state


def trigger(batches, delay=0, **kw):
    fn = SM._trigger(10, kw["look"], kw["need"], kw["collect"], 1.0)
    return stream(fn, batches, lambda rows: pd.DataFrame({"slot": [s for s, _ in rows], "r": [float(a) for _, a in rows]}), lambda x: x[0] * 1000 + 9999, delay * 1000,
                  lambda o: (o.opened_s, o.closed_s, o.slots))


ROWS = [(i * 10, i in (3, 4, 9, 30, 31, 32)) for i in range(60)]
WANT = [(50, 140, 10), (320, 370, 6)]


@pytest.mark.parametrize("size", [1, 4, 60])
def test_trigger_does_not_depend_on_batches(size):
    batches = [ROWS[i:i + size] for i in range(0, len(ROWS), size)]
    # two active slots in the past open a collection, it lasts 50 s past the last active slot
    assert trigger(batches, look=40, need=2, collect=50)[0] == WANT
    # a memory longer than the collection still holds 300, 310 and 320 at 380, so the rule opens once more
    assert trigger(batches, look=100, need=2, collect=50)[0] == WANT + [(380, 430, 6)]


@pytest.mark.parametrize("seed", range(5))
def test_trigger_takes_slots_in_any_order_within_the_delay(seed):
    rng = random.Random(seed)
    rows = sorted(ROWS, key=lambda x: x[0] + rng.uniform(0, 80))
    assert trigger([rows[i:i + 3] for i in range(0, 60, 3)], delay=120, look=40, need=2, collect=50)[0] == WANT


def test_timer_closes_what_no_later_slot_would_close_and_state_is_let_go():
    out, state = trigger([ROWS[:6], [(5000, False)], []], look=40, need=2, collect=50)
    assert out == [(50, 100, 1)] and state.exists  # 5000 itself still waits for the watermark
    out, state = trigger([ROWS[:6], [(5000, False)], [(9000, False)]], look=40, need=2, collect=50)
    assert out == [(50, 100, 1)] and state.value[:3] == ([9000], [0.0], [])


def latest(batches, delay_us=0, age_us=100_000):
    fn = SM._latest(age_us)
    frame = lambda rows: pd.DataFrame(rows, columns=["us", "id", "is_cycle", "value"])
    return stream(fn, batches, frame, lambda x: x[0] / 1000, delay_us / 1000, lambda o: (o.id, o.cycle_us, o.value))


def test_latest_cycle_waits_for_late_ones():
    rng = random.Random(3)
    scans = [(rng.randrange(1, 2_000_000), k, False, 0.0) for k in range(200)]
    cycles = [(rng.randrange(1, 2_000_000), -1, True, float(k)) for k in range(40)]
    known = {c: max(v for t, _, _, v in cycles if t == c) for c, *_ in cycles}
    rows = sorted(scans + cycles, key=lambda x: x[0] + rng.uniform(0, 250_000))
    end = (5_000_000, 999, False, 0.0)
    out, state = latest([rows[i:i + 7] for i in range(0, len(rows), 7)] + [[end]], 300_000)
    want = []
    for t, i, _, _ in scans:
        c = max((c for c in known if c <= t), default=None)
        want.append((i, c, known[c]) if c is not None and t - c <= 100_000 else (i, -1, 0.0))
    assert sorted(out) == sorted(want)
    assert state.value[0] == [999] and state.value[2] == []  # old cycles are gone


def test_state_of_latest_cycle_stays_small():
    fn, state, sizes = SM._latest(1_000), State(), []
    for k in range(1, 300):
        state.mark = k - 1
        list(fn(("d",), iter([pd.DataFrame([(k * 1000, k, k % 2 == 0, 1.0)], columns=["us", "id", "is_cycle", "value"])]), state))
        sizes.append(sum(len(x) for x in state.value) if state.exists else 0)
    assert max(sizes) <= 8
    state.mark = 10_000
    list(fn(("d",), iter([]), state))
    assert not state.exists


def test_late_report_run_twice_changes_nothing(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=m)
    parts = [[(at(0),), (at(5),)], [(at(90),), (at(1),)], [(at(2),), (at(95),), (at(85),)], []]
    frames = [spark.createDataFrame(p, "t timestamp") for p in parts]
    run = SM.late_report(str(tmp_path / "sink"), 60, 600)
    for i, f in enumerate(frames):
        run(f, i)
    shown = lambda: sorted((r.slot.hour, r["rows"], r.late) for r in SM.late_table(spark, str(tmp_path / "sink")).collect())
    # 12:01 isn't late after 12:05 with ten minutes; 12:02 is after 13:30, 13:25 isn't
    first = shown()
    assert [x[1:] for x in first] == [(4, 1), (3, 0)]
    for i in (1, 2, 3):
        run(frames[i], i)
    assert shown() == first


def test_latest_cycle_of_many_keys_in_one_group():
    rng = random.Random(4)
    rows = [(rng.randrange(5), rng.randrange(1, 2_000_000), k, k % 4 == 0, float(k)) for k in range(600)]
    late = sorted(rows, key=lambda x: x[1] + rng.uniform(0, 250_000))
    frame = lambda b: pd.DataFrame([(k, t, -1 if c else i, c, v) for k, t, i, c, v in b], columns=["key", "us", "id", "is_cycle", "value"])
    batches = [late[i:i + 50] for i in range(0, len(late), 50)] + [[(9, 5_000_000, 999, False, 0.0)]]
    out, state = stream(SM._latest(100_000), batches, frame, lambda x: x[1] / 1000, 300, lambda o: (o.key, o.id, o.cycle_us, o.value))
    want = []
    for k, t, i, c, _ in rows:
        if not c:
            past = [(ct, v) for ck, ct, _, cc, v in rows if cc and ck == k and ct <= t and t - ct <= 100_000]
            want.append((k, i, *max(past, default=(-1, 0.0))))
    assert sorted(out) == sorted(want)
    assert state.value[0] == [999] and state.value[4] == [9] and state.value[2] == state.value[5] == []
