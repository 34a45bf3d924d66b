import datetime as dt
import random

from tidemark.functions.spelling import edit_distance, label_key
from tidemark.llm.event_runs import DAY_US, event_runs

LABELS, FILLERS = ("bull", "bear", "crisis", "sideways", "unknown"), ("market", "regime")
SCHEMA = "row_id long, symbol string, ts timestamp, regime string, recorded_at timestamp, label string, run int, t int"
D0 = dt.datetime(2020, 1, 1)


def runs(spark, rows, **more):
    df = spark.createDataFrame([(i, s, None if t is None else D0 + dt.timedelta(days=t), r, None, "x", 1, 2) for i, (s, t, r) in enumerate(rows)], SCHEMA)
    zero = int(D0.replace(tzinfo=dt.UTC).timestamp() * 1e6)
    return sorted((r.entity, r.label, (r.start_us - zero) // DAY_US, (r.end_us - zero) // DAY_US, r.n_events) for r in event_runs(df, "symbol", "ts", "regime", ("recorded_at", "row_id"), LABELS, FILLERS, **more).collect())


def test_spellings():
    for label, texts in {"bull": ["bull", " BULL", "bulll", "büll", "Bull Market", "bull_market", "bull-regime", "bull."], "bear": ["bera", "beear", "regime: bear", "Bear-Market"], "crisis": ["crysis", "cri sis", "(crisis)", "crisis_regime"], "sideways": ["sidewyas", "side-ways", "\tsideways", "sideway"], "unknown": ["<unknown>", "unknwon"]}.items():
        assert {label_key(t, LABELS, FILLERS) for t in texts} == {label}
    assert label_key(None, LABELS, FILLERS) is None and label_key(" \t", LABELS, FILLERS) is None
    assert label_key("boat", LABELS, FILLERS) == "boat" and label_key("???", LABELS, FILLERS) == "???" and label_key("market", LABELS, FILLERS) == "market"
    assert edit_distance("ab", "ba", 2) == 1 and edit_distance("abc", "xyz", 2) == 3


def test_equals_brute_force_over_blocks(spark):
    rnd = random.Random(1)
    rows = []
    for s in "AB":
        label = "bull"
        for t in range(400):
            if rnd.random() < 0.1:
                label = rnd.choice(LABELS)
            if rnd.random() < 0.8:
                rows.append((s, t, rnd.choice([label, label.upper(), f" {label} market", None, "  "])))
                if rnd.random() < 0.2:
                    rows.append((s, t, label))
    want = []
    for s in "AB":
        days = {}
        for e, t, r in rows:
            key = label_key(r, LABELS, FILLERS)
            if e == s and key:
                days[t] = key
        run = None
        for t in sorted(days):
            if run and run[1] == days[t]:
                run[3], run[4] = t, run[4] + 1
            else:
                run = [s, days[t], t, t, 1]
                want.append(run)
    for block in (7, 64, 100_000):
        rnd.shuffle(rows)
        assert len({(s, t): 1 for s, t, _ in rows}) and runs(spark, rows, block_events=block) == sorted(map(tuple, want))


def test_dirt(spark):
    assert runs(spark, []) == []
    assert runs(spark, [("A", 1, None), (None, 1, "bull"), ("A", None, "bull"), ("A", 2, "")]) == []
    assert runs(spark, [("A", 1, "bull"), ("A", 1, "bear"), ("A", 5, "Bear")]) == [("A", "bear", 1, 5, 2)]  # the later row of a time holds
    assert runs(spark, [("A", 1, "bull"), ("A", 2, None), ("A", 30, "bull")] * 2) == [("A", "bull", 1, 30, 2)]
