import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.dependency_tree import fit_tree, posterior_modes
from tidemark.operators.panel_impute import fill_panel

SCHEMA = "obs_id long, load_id long, column_no int, entity_id string, name string, freq string, obs_date date, value double, slot string, bin int"
NAMES = "^(PMI|cpi)$"


def panel(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)


def good(loads=6, months=12):
    rows = []
    for load in range(loads):
        for c, name in ((1, "PMI"), (2, "cpi")):
            for m in range(months):
                entity = "NAAAA" if load % 2 else "NBBBB"
                rows.append([len(rows), load, c if entity == "NAAAA" else 3 - c, entity, name, "ME", dt.date(2000 + load, m + 1, 28), (50 if name == "PMI" else 2) + m / 10 + load / 100])
    return rows


def test_fills_every_gap_rightly(spark):
    rows = good()
    truth = {r[0]: (r[3], r[4], r[7]) for r in rows}
    for k, bad in ((3, None), (10, "?"), (30, " "), (31, "N/A"), (55, "nan")):
        rows[k][3] = bad
    for k, bad in ((4, None), (33, "Unnamed: 3"), (60, "feature_?"), (61, "")):
        rows[k][4] = bad
    for k in range(24, 36):
        rows[k][4] = None  # a whole series of a load
    for k, bad in ((7, None), (40, float("nan")), (41, -9999.0), (62, 1e30), (63, float("inf"))):
        rows[k][7] = bad
    out = {r.row_id: r for r in fill_panel(panel(spark, rows), valid_name=NAMES).collect()}
    assert {k: (r.entity, r.name) for k, r in out.items()} == {k: v[:2] for k, v in truth.items()}
    assert {k for k, r in out.items() if r.entity_filled} == {3, 10, 30, 31, 55} and {k for k, r in out.items() if r.name_filled} == {4, 60, 61, *range(24, 36)}
    assert {k for k, r in out.items() if r.value_filled} == {7, 40, 41, 62, 63}
    assert all(abs(r.value - truth[k][2]) < 0.15 * abs(truth[k][2]) for k, r in out.items())


def test_duplicates_null_keys_and_nothing_known(spark):
    rows = good(2)
    rows += [[900, *rows[5][1:]], [901, *rows[5][1:7], None], [902, None, None, "NAAAA", "PMI", None, None, None]]
    out = {r.row_id: r for r in fill_panel(panel(spark, rows), valid_name=NAMES).collect()}
    assert len(out) == len(rows) and out[901].value == rows[5][7] and out[902].value is not None
    nothing = [[1, 1, 1, None, None, "ME", dt.date(2000, 1, 1), None]]
    r = fill_panel(panel(spark, nothing), valid_name=NAMES).collect()[0]
    assert (r.entity, r.name, r.value) == (None, None, None) and r.entity_filled and r.name_filled and r.value_filled
    assert fill_panel(panel(spark, []), valid_name=NAMES).count() == 0


def test_tree_equals_enumeration(spark):
    data = [("a", "x", "p")] * 6 + [("a", "x", "q")] * 2 + [("b", "y", "p")] * 3 + [("b", "y", "q")] * 5 + [("b", "x", "q")]
    df = spark.createDataFrame(data, "u string, v string, w string")
    tree = fit_tree(df, ("u", "v", "w"))
    assert len(tree.edges) == 2 and (0, 1) in [e[:2] for e in tree.edges]
    asked = spark.createDataFrame([(None, "x", "p"), (None, "y", None), (None, None, "q"), (None, "new", None)], "u string, v string, w string")
    got = {(r.v, r.w): r["mode"] for r in posterior_modes(tree, asked, "u").collect()}
    assert got == {("x", "p"): "a", ("y", None): "b", (None, "q"): "b", ("new", None): "b"}


def test_number_codes_need_to_be_far_off(spark):
    rows = good(2)
    for r in rows:
        r[7] = r[7] * 200 if r[4] == "PMI" else r[7]
    rows[3][7] = 9999.0  # within this series' range
    out = {r.row_id: r for r in fill_panel(panel(spark, rows), valid_name=NAMES).collect()}
    assert not out[3].value_filled and out[3].value == 9999.0
    assert fill_panel(panel(spark, rows), valid_name=NAMES).where(F.col("value_filled")).count() == 0
