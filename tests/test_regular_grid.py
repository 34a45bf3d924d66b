import datetime as dt
import random

import pytest

from tidemark.operators import regular_grid as module
from tidemark.operators.regular_grid import regular_grid

T0 = dt.datetime(2021, 5, 1)
Q = "reading_id long, symbol string, ts timestamp, close double, feed string, arrived_at timestamp, slot int, average double"
W = "window_id long, symbol string, start_ts timestamp, end_ts timestamp, grid_seconds int, slot int"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def frames(spark, quotes, windows):
    return spark.createDataFrame([(i, s, None if t is None else at(t), v, None, a, 1, 1.0) for i, (s, t, v, a) in enumerate(quotes)], Q), spark.createDataFrame([(i, s, at(a), at(b), g, 1) for i, (s, a, b, g) in enumerate(windows)], W)


def brute(quotes, windows):
    out = {}
    for k, (s, a, b, g) in enumerate(windows):
        if s is None or g is None or g <= 0 or a >= b:
            continue
        seen = sorted((t, x or dt.datetime(1, 1, 1), i, v) for i, (q, t, v, x) in enumerate(quotes) if q == s and t is not None and v is not None and v == v and a <= t < b)
        steps = [(t, seen[j + 1][0] if j + 1 < len(seen) else b, v) for j, (t, _, _, v) in enumerate(seen)]
        for i in range(-(-(b - a) // g)):
            lo, hi = a + i * g, min(b, a + (i + 1) * g)
            parts = [(min(e, hi) - max(t, lo), v) for t, e, v in steps if min(e, hi) > max(t, lo)]
            cover = sum(p for p, _ in parts)
            n = sum(a + i * g <= t < a + (i + 1) * g for t, *_ in seen)
            out[k, i] = (n, round(sum(p * v for p, v in parts) / cover, 6) if cover else None, round(cover / (hi - lo), 6))
    return out


def got(df):
    return {(r.window, r.slot): (r.n_readings, None if r.average is None else round(r.average, 6), round(r.coverage, 6)) for r in df.collect()}


@pytest.mark.parametrize("block", [3, 1024])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_SLOTS", block)
    rnd = random.Random(block)
    quotes = [(rnd.choice("AB"), rnd.randrange(0, 1000), rnd.choice([rnd.uniform(1, 9), rnd.uniform(1, 9), None, float("nan"), -2.0]), rnd.choice([None, at(rnd.randrange(2000))])) for _ in range(150)]
    quotes += [("A", 100, 5.0, at(1)), ("A", 100, 6.0, at(2)), (None, 5, 1.0, None), ("A", None, 1.0, None), ("C", 5, 1.0, None), quotes[0]]
    windows = [("A", 0, 305, 10), ("A", 400, 900, 60), ("B", 50, 950, 7), ("D", 0, 50, 10), (None, 0, 50, 10), ("B", 960, 960, 5)]
    assert got(regular_grid(*frames(spark, quotes, windows))) == brute(quotes, windows)


def test_status_and_held(spark):
    df = regular_grid(*frames(spark, [("A", 25, 4.0, None)], [("A", 0, 50, 10)])).orderBy("slot").collect()
    assert [r.status for r in df] == ["missing", "missing", "observed", "filled", "filled"]
    assert [r.held for r in df] == [None, None, 4.0, 4.0, 4.0] and [r.slot_epoch - df[0].slot_epoch for r in df] == [0, 10, 20, 30, 40]


def test_infinite_and_empty(spark):
    df = regular_grid(*frames(spark, [("A", 5, float("inf"), None)], [("A", 0, 10, 10)])).collect()
    assert df[0].n_readings == 1 and df[0].average == float("inf")
    assert regular_grid(*frames(spark, [], [("A", 0, 20, 10)])).where("n_readings = 0").count() == 2
    assert regular_grid(*frames(spark, [("A", 5, 1.0, None)], [])).count() == 0
