import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rule_scoring as rs
from tidemark.operators import text as tx
from tidemark.sources import catalog, config, extractor, files


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string")


def test_sections_and_context(spark):
    t = "start\nPAYMENT: \nwithin 30 days\nTERM:\nENDING:\nlast. word indemnify here. more\n2. Fees due:\n\nARTICLE IV Scope of work\nall\nNo header: x\nPAYMENT:\n again \n"
    got = {r.section: r.content for r in tx.sections(docs(spark, t, None), "doc_id", "body").where("doc = 0").collect()}
    assert got == {"PREAMBLE": "start", "PAYMENT": "again", "ENDING": "last. word indemnify here. more", "2. Fees due": "", "ARTICLE IV Scope of work": "all\nNo header: x"}
    assert tx.in_context(t, ["indemnify", "absent"], 3) == ["word indemnify here."]
    assert tx.keyword_in_context(docs(spark, t, "x", None), "doc_id", "body", ["indemnify"], 3).count() == 1


def test_metadata_and_truncation(spark):
    r = tx.metadata(docs(spark, " a  bé\nc ", None), "doc_id", "body").orderBy("doc").collect()
    assert (r[0].word_count, r[0].character_count, r[0].byte_size) == (3, 9, 10) and r[1].word_count == 0
    got = docs(spark, "x" * 11, "ab").select(tx.truncate_middle(F.col("body"), 10, "|").alias("m"), tx.truncate_end(F.col("body"), 3, "...").alias("e")).collect()
    assert (got[0].m, got[0].e, got[1].m, got[1].e) == ("xxxxx|xxxxx", "xxx...", "ab", "ab")


def test_answers(spark):
    texts = ['{"status": "PRESENT", "confidence": 7}', 'so {no} {"status": "partial"} yes', '{"a": {"b": 1}, "status": "n/a"}', "nothing", None, '{"status": "odd"}']
    expected = F.array(F.lit("e"))
    got = docs(spark, *texts).orderBy("doc_id").select(tx.normalise_answer(tx.parse_answer(F.col("body")), expected).alias("a")).collect()
    assert [r.a.status for r in got] == ["present", "partial", "n/a", "missing", "missing", "missing"]
    assert got[0].a.confidence == 1.0 and got[1].a.missing_elements == ["e"]


@pytest.mark.parametrize("p,s,c,want", [(1, 1, 1, 1.0), (0, 0, 0, 0.0), (1, 0.5, 0, 0.5)])
def test_component_score(spark, p, s, c, want):
    row = spark.range(1).select(rs.component_score(F.lit(float(p)), F.lit(float(s)), F.lit(float(c))).alias("x"), rs.component_score(F.lit(1.0), F.lit(0.0), F.lit(0.0), (2, 1, 1)).alias("y")).first()
    assert abs(row.x - want) < 1e-12 and abs(row.y - 0.5) < 1e-12


def test_buckets_and_roll_up(spark):
    df = spark.createDataFrame([(0.96,), (0.8,), (0.7,), (0.5,), (0.1,)], "s double").select(rs.risk(F.col("s")).alias("r"), rs.maturity(F.col("s")).alias("m")).collect()
    assert [r.r for r in df] == ["low", "low", "low", "medium", "high"] and [r.m for r in df] == [5, 4, 3, 2, 1]
    rules = rs.rules_table(spark, [rs.Rule("a", "A", ("alpha",), ("alpha beta",), 0.9), rs.Rule("b", "B", (), ())])
    scored = rs.rule_scores(rs.keyword_extraction(docs(spark, "alpha beta " * 10, "", None), rules, "doc_id", "body"))
    out = {r.doc: r for r in rs.document_scores(scored).collect()}
    assert out[0].present == 1 and out[0].missing == 1 and out[1].risk == "high" and out[2].exposure == 1.0
    assert rs.ranked_findings(scored).count() > 0
    w = rs.with_weights(rules, spark.createDataFrame([("a", 0.7)], "rule string, weight double")).orderBy("rule").collect()
    assert [r.weight for r in w] == [0.7, rs.DEFAULT_WEIGHT]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,value\n2020Q1,1.5\n2020Q2,x\nbad,3\n")
    (tmp_path / "b.csv").write_text("date,p,v\n2020-03-31,1,2\n2020-09-30,3,4\n")
    a = files.read_csv(spark, str(tmp_path / "a.csv")).orderBy("ts").collect()
    assert [(r.ts, r.value) for r in a] == [(dt.date(2020, 3, 31), 1.5), (dt.date(2020, 6, 30), None)]
    m = files.merge_csv(spark, {"gdp": str(tmp_path / "a.csv"), "k": str(tmp_path / "b.csv")}).collect()
    assert [(r.ts.month, r.gdp, r.k_p, r.k_v) for r in m] == [(3, 1.5, 1.0, 2.0), (6, None, None, None), (9, None, 3.0, 4.0)]
    assert files.close_column(["a", "BTC_Close"]) == "BTC_Close" and files.target_column(["x", "y_t", "entity_id"]) == "y_t" and files.target_column(["p", "q"]) == "q"


def test_documents_and_json(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.md").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes("é".encode("utf-16"))
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    assert sorted(r.text for r in files.read_documents(spark, str(tmp_path)).collect()) == ["é", "é", "é"]
    body = json.dumps({"prices": [[0, 1.5], [86400000, 2.0]]})
    assert [r.value for r in files.price_arrays(spark.createDataFrame([("b", body), ("c", "no")], "s string, j string"), "s", "j").orderBy("ts").collect()] == [1.5, 2.0]
    fg = json.dumps({"data": [{"value": "40", "timestamp": "86400"}, {"value": "50", "timestamp": "0"}]})
    assert [r.value for r in files.fear_and_greed(spark.createDataFrame([(fg,)], "j string"), "j").collect()] == [50.0, 40.0]


def test_catalogue(spark):
    obs = spark.createDataFrame([("DGS10", dt.date(2020, 1, k), 2.0) for k in (1, 2)] + [("DGS2", dt.date(2020, 1, 1), 0.5), ("T10Y2Y", dt.date(2020, 1, 3), 9.0), ("SOFR", dt.date(2020, 1, 1), 1.0), ("SOFR", dt.date(2020, 1, 2), None)], "code string, ts date, value double")
    assert [r.slope for r in catalog.slope(obs).orderBy("ts").collect()] == [1.5, 9.0]
    assert catalog.load_bundle(obs, "rates_dashboard", "2020-01-02").count() == 1
    assert {r.grp for r in catalog.load_groups(obs, ("repo_rates", "sofr_libor")).collect()} == {"repo_rates", "sofr_libor"}
    with pytest.raises(ValueError, match="macro_us"):
        catalog.load_bundle(obs, "none")


def test_rule_files(tmp_path):
    (tmp_path / "r.yaml").write_text("clauses:\n- id: a\n  keywords: [x]\n- id: b\n  required: false\n")
    (tmp_path / "w.yaml").write_text("weights:\n  a: 0.9\n")
    rules = config.load_rules(str(tmp_path / "r.yaml"), str(tmp_path / "w.yaml"))
    assert [(r.rule, r.weight, r.required, r.risk_if_missing) for r in rules] == [("a", 0.9, True, "medium"), ("b", None, False, "medium")]
    with pytest.raises(FileNotFoundError):
        config.load_yaml(str(tmp_path / "none.yaml"))


def test_extractor_never_fails(spark):
    def ask(prompt):
        if "bad" in prompt:
            raise OSError("down")
        return prompt.upper()

    got = {r.doc: (r.answer, r.error) for r in extractor.ask_all(spark.createDataFrame([(1, "r", "ok"), (2, "r", "bad")], "doc int, rule string, prompt string"), ask).collect()}
    assert got == {"1": ("OK", None), "2": (None, "OSError: down")}


def test_prompts_and_sql_functions(spark, sf_dir):
    from tidemark.functions.registered import register_functions, register_views
    from tidemark.sources import synthetic

    rules = rs.rules_table(spark, [rs.Rule("a", "Alpha", ("x", "y"), ("e",))])
    p = extractor.prompts(docs(spark, "text " * 5000, None), rules, "doc_id", "body").collect()
    assert len(p) == 2 and all("Alpha" in r.prompt and len(r.prompt) < 9000 for r in p)
    register_functions(spark)
    assert abs(spark.sql("select chi2_tail(18.307D, 10D)").first()[0] - 0.05) < 1e-4
    assert spark.sql("select keyword_passages('One. two audit three. four', 'audit', 2)").first()[0] == ["two audit three."]
    assert spark.sql("select count(*) from ffd_weights(1.0D, 0.01D)").first()[0] == 2
    assert "orders" in register_views(spark, sf_dir) and spark.sql("select count(*) from orders").first()[0] > 0
    s = synthetic.causal_system(100)
    assert set(s) == {"X1", "X2", "X3", "X4", "Y"} and set(synthetic.CAUSES) == set(s) - {"Y"}
    assert abs(s["X3"][1:] - 0.5 * s["X3"][:-1] - 0.6 * np.sin(5 * s["X1"][:-1])).max() < 1e-12
    assert np.std(s["Y"][1:] - 0.5 * s["Y"][:-1] - 0.4 * s["X2"][:-1] - 0.5 * s["X3"][:-1] ** 2) < 0.1
    assert synthetic.as_series(spark, a=synthetic.random_walk(10), b=synthetic.trending(5)).count() == 15
    with pytest.raises(ValueError):
        synthetic.autoregression(10, 1.0)


def test_save_and_read_reports(spark, tmp_path):
    from tidemark.operators import report

    report.save(spark.createDataFrame([("a", "# x")], "series_id string, markdown string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().markdown == "# x"
    with pytest.raises(ValueError):
        report.save(spark.range(1), str(tmp_path / "q"), "xml")
