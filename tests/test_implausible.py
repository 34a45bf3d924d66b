import datetime as dt

import numpy as np
import pytest

from tidemark.kernels.hampel import deviation_bins, rolling_median, run_lengths, smallest_step
from tidemark.operators.implausible import Bounds, implausible_readings

SCHEMA = "reading_id long, symbol string, ts timestamp, close double, source string, t int, v string, kind string"
T0 = dt.datetime(2021, 5, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, s, None if t is None else T0 + dt.timedelta(seconds=t), v, "x", 1, "y", "z") for i, (s, t, v) in enumerate(rows)], SCHEMA)


def flags(spark, rows, **more):
    out = implausible_readings(frame(spark, rows), "symbol", "ts", "close", "reading_id", Bounds(0.0, True), log_scale=True, **more).collect()
    return {(r.row_id, r.kind) for r in out}


def walk(n, seed=0):
    return np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.001, n)) + 3)


@pytest.mark.parametrize("block_rows", [200, 100_000])
def test_finds_what_was_put_in_and_no_shift(spark, block_rows):
    v = walk(3000)
    v[1500:] *= 1.5  # a lasting shift is no spike
    spikes, stuck = [100, 700, 701, 2500], range(2000, 2030)
    v[spikes] *= 1.2
    v[list(stuck)] = v[2000]
    rows = [("A", k, float(x)) for k, x in enumerate(v)]
    rows += [("A", 100, rows[100][2]), ("A", 5, None), ("A", 6, float("nan")), ("A", 7, 0.0), ("A", 8, -3.0), ("A", 9, float("inf")), (None, 9, -1.0), ("A", None, 5.0), ("B", 1, 2.0)]
    n = len(v)
    want = {(k, "spike") for k in [*spikes, n]} | {(k, "stuck") for k in list(stuck)[1:]} | {(n + k, "impossible") for k in (3, 4, 5, 6)}
    assert flags(spark, rows, block_rows=block_rows) == want


def test_coarse_steps_are_no_stuck_values(spark):
    v = np.round(walk(2000, 5) * 20) / 20
    assert not [f for f in flags(spark, [("A", k, float(x)) for k, x in enumerate(v)]) if f[1] == "spike"]
    assert len([f for f in flags(spark, [("A", k, float(x)) for k, x in enumerate(v)]) if f[1] == "stuck"]) < 20


def test_small_inputs(spark):
    assert flags(spark, []) == set()
    assert flags(spark, [("A", 1, 2.0)]) == set()
    assert flags(spark, [("A", k, 2.0) for k in range(50)]) == set()  # constant is what is usual for it
    assert flags(spark, [("A", 1, 2.0)] * 40) == set()
    with pytest.raises(ValueError):
        implausible_readings(frame(spark, []), "symbol", "ts", "close", "reading_id", Bounds(), log_scale=True)


def test_kernel():
    x = np.array([1.0, 2, 9, 3, 4])
    assert rolling_median(x, 1).tolist() == [1.5, 2, 3, 4, 3.5] and rolling_median(np.array([]), 3).tolist() == []
    assert [a.tolist() for a in run_lengths(np.array([1, 1, 2, 2, 2, 3]))] == [[0, 2, 5], [2, 3, 1]]


def test_many_spikes_don_t_hide_each_other(spark):
    v = walk(3000, 3)
    spikes = list(range(20, 2980, 10))  # one reading in ten
    v[spikes] *= 1.03
    rows = [("A", k, float(x)) for k, x in enumerate(v)]
    assert flags(spark, rows) == {(k, "spike") for k in spikes}


def test_deviations_are_counted_in_fine_bins():
    dev = np.random.default_rng(1).normal(0, 2, 5001)
    bins, counts = deviation_bins(np.r_[dev, 0.0])
    assert bins[0] == -(1 << 30) and counts.sum() == 5002
    middle = bins[np.searchsorted(np.cumsum(counts), 2501)]
    assert 2 ** ((middle + 0.5) / 1024) == pytest.approx(np.median(np.abs(dev)), rel=1e-3)
    assert smallest_step(np.array([1.0, 1.0, 1.5, 1.25])) == 0.25 and smallest_step(np.array([2.0])) == float("inf")


def brute_force(rows, half=7, z=12.5):
    """Spikes of each source by the plain definition, without blocks or bins."""
    found = set()
    for source in {r[0] for r in rows}:
        own = sorted({(t, v) for s, t, v in rows if s == source})
        x = np.log([v for _, v in own])
        dev = np.array([x[k] - np.median(x[max(0, k - half) : k + half + 1]) for k in range(len(x))])
        scale = 1.4826 * np.median(np.abs(dev))
        found |= {(k, "spike") for k, (s, t, v) in enumerate(rows) if s == source and abs(dev[own.index((t, v))]) > z * scale}
    return found


@pytest.mark.parametrize("block_rows", [60, 1000, 5000])
def test_calm_then_lively_is_judged_by_the_whole_source(spark, block_rows):
    rng = np.random.default_rng(5)
    v = np.exp(np.cumsum(np.r_[rng.normal(0, 0.0005, 2000), rng.normal(0, 0.004, 2000)]) + 3)
    v[rng.choice(4000, 40, replace=False)] *= np.exp(rng.uniform(0.01, 0.06, 40))
    t = np.r_[np.arange(3000), 3000 + np.arange(1000) // 8]  # a burst: eight readings a second
    rows = [("A", int(a), float(b)) for a, b in zip(t, v, strict=True)]
    got = {f for f in flags(spark, rows, block_rows=block_rows) if f[1] == "spike"}
    assert got == brute_force(rows) and len(got) > 10


@pytest.mark.parametrize("block_rows", [10, 64, 4000])
def test_runs_are_followed_across_any_number_of_blocks(spark, block_rows):
    v = walk(600, 8)
    v[100:400] = v[100]
    v[500:507] = v[500]
    rows = [("A", k, float(x)) for k, x in enumerate(v)]
    got = {f for f in flags(spark, rows, block_rows=block_rows) if f[1] == "stuck"}
    assert got == {(k, "stuck") for k in [*range(101, 400), *range(501, 507)]}
