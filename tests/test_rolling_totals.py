import datetime as dt
import random
from pathlib import Path

import pytest

from pyspark.errors import PySparkException

from tidemark.operators.rolling_totals import BLOCK_DAYS, RollingStore, advance, daily_amounts, empty_state, rolling_totals

SCHEMA = "symbol string, ts timestamp, close double, ingested_at timestamp, bar_id long, total int, day string, version int"


def day(k, hour=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=k, hours=hour)


def bars(spark, rows):
    return spark.createDataFrame([(s, t, c, i, b, 1, "x", 2) for s, t, c, i, b in rows], SCHEMA)


def brute(rows, periods=(7, 30)):
    best = {}
    for s, t, c, i, b in rows:
        if s is None or t is None or c is None or c != c or abs(c) == float("inf"):
            continue
        key, rank = (s, (t - dt.datetime(2020, 1, 1)).days), (i is not None, i or day(0), b)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, c)
    out = {}
    for s in {k[0] for k in best}:
        days = [d for x, d in best if x == s]
        for w in periods:
            for d in range(min(days), max(days) + 1):
                inside = [best[s, e][1] for e in range(d - w + 1, d + 1) if (s, e) in best]
                out[s, w, d] = (round(sum(inside), 2), len(inside))
    return out


def got(df):
    zero = (dt.date(2020, 1, 1) - dt.date(1970, 1, 1)).days
    return {(r.entity, r.win_days, r.day - zero): (round(float(r.total), 2), r.n) for r in df.collect()}


def test_equals_brute_force_with_dirt(spark):
    rnd = random.Random(3)
    rows = []
    for s in ("A", "B"):
        for k in range(0, 700, 1):
            if rnd.random() < 0.6:
                rows.append((s, day(k, rnd.randrange(24)), round(rnd.uniform(1, 99), 2), day(k + 1), len(rows)))
                if rnd.random() < 0.2:
                    rows.append((s, day(k), round(rnd.uniform(1, 99), 2), day(k + rnd.randrange(3)), len(rows)))
    rows += [("A", day(3), None, day(900), 9001), ("A", day(4), float("nan"), day(900), 9002), ("A", day(5), float("inf"), day(900), 9003), (None, day(1), 5.0, day(1), 9004), ("B", None, 5.0, day(1), 9005), ("B", day(2), 7.0, None, 9006), rows[0]]
    assert got(rolling_totals(bars(spark, rows))) == brute(rows)


def test_corrections_touch_only_what_they_reach(spark):
    rows = [("A", day(k), 1.0, day(k), k) for k in range(100)]
    one = advance(empty_state(spark), daily_amounts(bars(spark, rows), "symbol", "ts", "close", "ingested_at", "bar_id"), 1)
    fix = [("A", day(50), 3.0, day(200), 500)]
    two = advance(one, daily_amounts(bars(spark, fix), "symbol", "ts", "close", "ingested_at", "bar_id"), 2)
    assert got(two.totals) == brute(rows + fix)
    changed = {(r.win_days, r.day) for r in two.totals.where("version = 2").collect()}
    zero = (dt.date(2020, 1, 1) - dt.date(1970, 1, 1)).days
    assert changed == {(w, zero + d) for w in (7, 30) for d in range(50, 50 + w)}


def test_late_days_extend_both_ends(spark):
    rows = [("A", day(k), 1.0, day(k), k) for k in range(40, 60)]
    more = [("A", day(35), 2.0, day(99), 600), ("A", day(75), 4.0, day(99), 601)]
    step = lambda s, r, v: advance(s, daily_amounts(bars(spark, r), "symbol", "ts", "close", "ingested_at", "bar_id"), v)
    assert got(step(step(empty_state(spark), rows, 1), more, 2).totals) == brute(rows + more)


def test_empty(spark):
    assert rolling_totals(bars(spark, [])).count() == 0
    assert rolling_totals(bars(spark, [("A", day(1), None, None, 1)])).count() == 0


def amounts(spark, rows):
    return daily_amounts(bars(spark, rows), "symbol", "ts", "close", "ingested_at", "bar_id")


def test_a_correction_reads_and_writes_its_blocks_only(spark, tmp_path):
    rows = [(s, day(k), float(k % 13), day(k), 2000 * i + k) for i, s in enumerate(("A", "B")) for k in range(0, 2000, 1 + i)]
    store = RollingStore(spark, str(tmp_path))
    assert store.apply(amounts(spark, rows)) == 1
    fix = [("A", day(900), 50.0, day(3000), 9001)]
    first_day = (dt.date(2020, 1, 1) - dt.date(1970, 1, 1)).days
    assert set(store._reach(amounts(spark, fix))) == {(first_day + k) // BLOCK_DAYS for k in (900, 930)}
    assert store.apply(amounts(spark, fix)) == 2
    wrote = {p.parent.name for p in Path(tmp_path, "totals", "batch=2").rglob("*.parquet")}
    assert 1 <= len(wrote) <= 2
    assert {r.entity for r in spark.read.parquet(f"{tmp_path}/totals/batch=2").collect()} == {"A"}
    assert got(store.state().totals) == brute(rows + fix)
    more = [("A", day(2100), 1.0, day(3001), 9002), ("C", day(5), 1.0, day(3001), 9003), ("B", day(-3), 2.0, day(3001), 9004)]
    store.apply(amounts(spark, more))
    assert got(store.state().totals) == brute(rows + fix + more)
    store.apply(amounts(spark, []))
    assert got(store.state().totals) == brute(rows + fix + more)


def test_an_amount_too_large_is_an_error(spark):
    with pytest.raises(PySparkException):
        rolling_totals(bars(spark, [("A", day(1), 1e25, day(1), 1)])).collect()
