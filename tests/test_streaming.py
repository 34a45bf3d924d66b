import datetime as dt

from tidemark.streaming import windows

T0 = dt.datetime(2020, 1, 1)
SCHEMA = "ts timestamp, k string, v double"


def stream(spark, tmp_path, rows):
    spark.createDataFrame([(T0 + dt.timedelta(minutes=m), k, v) for m, k, v in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    return windows.read_stream(spark, str(tmp_path / "in"), "*.parquet", SCHEMA)


def test_tumbling_and_sliding(spark, tmp_path):
    s = stream(spark, tmp_path, [(0, "a", 1.0), (30, "a", 2.0), (90, "a", 4.0), (5, "b", None)])
    got = {(r.start, r.k): (r.n, r.total, r.last) for r in windows.run_to_end(windows.tumbling(s, "k", "v", "1 hour"), "t1", "complete").collect()}
    assert got == {(T0, "a"): (2, 3.0, 2.0), (T0 + dt.timedelta(hours=1), "a"): (1, 4.0, 4.0), (T0, "b"): (1, None, None)}
    assert windows.run_to_end(windows.sliding(s, "k", "v", "1 hour", "30 minutes"), "t2", "complete").where("k = 'a'").agg({"n": "sum"}).first()[0] == 6


def test_sessions_and_state(spark, tmp_path):
    s = stream(spark, tmp_path, [(0, "a", 1.0), (10, "a", 3.0), (100, "a", 5.0)])
    assert sorted(r.n for r in windows.run_to_end(windows.sessions(s, "k", "30 minutes"), "t3", "complete").collect()) == [1, 2]
    r = windows.run_to_end(windows.local_level(s, "k", "v"), "t4", "update").collect()[-1]
    a, p = 1.0, 1.0
    for y in (3.0, 5.0):
        p += 0.1
        g = p / (p + 1)
        a, p = a + g * (y - a), p * (1 - g)
    assert r.n == 3 and abs(r.level - a) < 1e-12 and abs(r.variance - p) < 1e-12
