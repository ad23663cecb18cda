import random

import pytest
from pyspark.sql import functions as F

from millrace.config import Params
from millrace.operators import reorder
from millrace.streaming.detector import KeyedDetector

CASES = [
    (1, [2, 1, 4, 3, 5], [1, 2, 3, 4, 5]),
    (1, [5, 6, 4, 7], [5, 6, 7]),
    (1, [1, 2, 4, 5], [1, 2]),
    (1, [1, 2, 4, 4, 3], [1, 2, 3, 4]),
    (3, [3, 1, 2, 4], [1, 2, 3, 4]),
]
SCHEMA = "machine int, sensor int, arrival long, ts long, value double"


def rows_of(key, times):
    return [(key, 0, a, t, float(a)) for a, t in enumerate(times)]


def machine(times, m):
    """(time, value) released by the state machine that streaming uses."""
    d = KeyedDetector(Params(window=1, delta=1, min_sequence=m), 1)
    return [r[:2] for a, t in enumerate(times) for r in d.push(t, float(a))]


@pytest.mark.parametrize("m,times,out", CASES)
def test_fixtures(spark, m, times, out):
    df = spark.createDataFrame(rows_of(1, times), SCHEMA)
    got = [(r["ts"], r["value"]) for r in reorder.released(df, m).orderBy("ts").collect()]
    assert [t for t, _ in got] == out
    assert got == machine(times, m)


@pytest.mark.parametrize("m", [1, 2, 3])
def test_closed_form_equals_state_machine(spark, m):
    rnd = random.Random(m)
    keys = {}
    for key in range(150):
        times = [t for t in range(12) if rnd.random() > 0.08]
        times += rnd.choices(times or [0], k=rnd.randint(0, 3))
        times.sort(key=lambda t: t + rnd.random() * rnd.choice([0, 1, 3, 6]))
        keys[key] = times
    df = spark.createDataFrame([r for k, t in keys.items() for r in rows_of(k, t)], SCHEMA)
    got = {k: [] for k in keys}
    for r in reorder.released(df, m).orderBy("machine", "ts").collect():
        got[r["machine"]].append((r["ts"], r["value"]))
    assert got == {k: machine(t, m) for k, t in keys.items()}


def test_every_row_has_a_fate(spark):
    df = spark.createDataFrame(rows_of(1, [5, 6, 4, 8, 8]) + rows_of(2, [1]), SCHEMA)
    fates = {(r["machine"], r["arrival"]): r["fate"] for r in reorder.classify_arrivals(df).collect()}
    assert fates == {(1, 0): "released", (1, 1): "released", (1, 2): "late", (1, 3): "blocked", (1, 4): "blocked", (2, 0): "waiting"}
    assert reorder.in_time_order(df).where(F.col("machine") == 1).count() == 4


def count_machine(times, length):
    """What the sorter by counts passes on for one key, row by row and then at the end."""
    pending, now, steady, out = {}, None, False, []

    def drain(flushed):
        nonlocal now
        while now in pending:
            out.append((now, pending.pop(now), flushed))
            now += 1

    for arrival, t in enumerate(times):
        if steady and t < now:
            continue
        pending[t] = float(arrival)
        if not steady:
            now = min(pending)
            steady = len(pending) > length and all(now + j in pending for j in range(length))
        if steady:
            drain(False)
    if not steady and pending:
        drain(True)
    return out, len(pending)


def time_machine(times, m, delay):
    """The same of the sorter by time, with the arrival as its clock."""
    pending, now, until, steady, out = {}, None, None, False, []
    for clock, t in enumerate(times):
        lowered = now is not None and t < now and not steady
        if now is None or lowered:
            now, until = t, clock + delay
        pending[t] = float(clock)
        if not steady and not lowered and clock >= until:
            told = sorted(pending)
            steady = len(told) > m and told[m] == now + m
        while steady and pending and min(pending) == now:
            out.append((now, pending.pop(now), False))
            now += 1
    return out + [(t, pending[t], True) for t in sorted(pending)]


def disturbed(seed, n=150):
    rnd = random.Random(seed)
    keys = {}
    for key in range(n):
        times = [t for t in range(12) if rnd.random() > 0.08] or [0]
        times += rnd.choices(times, k=rnd.randint(0, 3))
        times.sort(key=lambda t: t + rnd.random() * rnd.choice([0, 1, 3, 6]))
        keys[key] = times
    return keys


@pytest.mark.parametrize("m,parallelism", [(1, 1), (1, 2), (2, 2)])
def test_count_sorter_equals_its_state_machine(spark, m, parallelism):
    keys = disturbed(m + 10 * parallelism)
    df = spark.createDataFrame([r for k, t in keys.items() for r in rows_of(k, t)], SCHEMA)
    got = {k: [] for k in keys}
    for r in reorder.count_sorted(df, m, parallelism).orderBy("machine", "ordinal").collect():
        got[r["machine"]].append((r["ts"], r["value"], r["flushed"]))
    want = {k: count_machine(t, m * parallelism) for k, t in keys.items()}
    assert got == {k: w[0] for k, w in want.items()}
    ends = {r["machine"]: (r["pending"], r["passed"]) for r in reorder.count_sorter_ends(df, m, parallelism).collect()}
    assert ends == {k: (w[1], not w[1]) for k, w in want.items()}


@pytest.mark.parametrize("m,delay", [(1, 0), (1, 2), (2, 1), (3, 4)])
def test_time_sorter_equals_its_state_machine(spark, m, delay):
    keys = disturbed(m + 10 * delay)
    df = spark.createDataFrame([r for k, t in keys.items() for r in rows_of(k, t)], SCHEMA).withColumn("clock", F.col("arrival"))
    got = {k: [] for k in keys}
    for r in reorder.time_sorted(df, m, 1, delay).orderBy("machine", "ordinal").collect():
        got[r["machine"]].append((r["ts"], r["value"], r["flushed"]))
    assert got == {k: time_machine(t, m, delay) for k, t in keys.items()}


def test_late_rows_block_the_sorter_by_time(spark):
    df = spark.createDataFrame(rows_of(1, [5, 6, 7, 2, 8, 9]), SCHEMA).withColumn("clock", F.col("arrival"))
    got = [(r["ts"], r["flushed"]) for r in reorder.time_sorted(df).orderBy("ordinal").collect()]
    assert got == [(5, False), (6, False), (7, False), (2, True), (8, True), (9, True)]
