import pytest

from tidemark.llm.mixing import TOKENIZER, count_tokens, encoding, finish_line, in_order, mix_sources

D, G = "doc_id long, source string, text string, tokens int, copy int, share double", "source string, target_share double, max_repeats int, doc string"


def docs(spark, sizes):
    rows, i = [], 0
    for s, n in sizes:
        for k in range(n):
            rows.append((i, s, "word " * (20 + (i * 7) % 30), 1, 1, 0.1))
            i += 1
    return spark.createDataFrame(rows, D)


def goals(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], G)


def test_counts_are_the_tokenizers(spark):
    texts = ["Hello world", "", None, "déjà vu 👍 \n\n", "x" * 5000]
    got = {r.doc: r.tokens for r in count_tokens(spark.createDataFrame([(i, "s", t, 1, 1, 1.0) for i, t in enumerate(texts)], D), "doc_id", "source", "text").collect()}
    assert got == {i: len(encoding(TOKENIZER).encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_shares_without_shortage(spark):
    m = mix_sources(docs(spark, [("a", 400), ("b", 400), ("c", 30)]), goals(spark, [("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 9)]), budget=10_000)
    r = {x.source: x for x in m.report.collect()}
    assert all(x.reachable for x in r.values()) and all(abs(r[s].actual_share - g) < 0.02 for s, g in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    chosen = m.chosen.collect()
    assert 9_700 < sum(x.tokens for x in chosen) <= 10_000 and len({(x.doc, x.copy) for x in chosen}) == len(chosen)
    c = [x for x in chosen if x.source == "c"]
    rounds = max(x.copy for x in c)
    assert all(sum(x.copy == k for x in c) == 30 for k in range(1, rounds))  # a round is finished before the next begins
    f = [x.finish for x in in_order(m, 4).collect()]
    assert f == sorted(f)


def test_shortage_caps_and_report(spark):
    d = docs(spark, [("a", 300), ("b", 5), ("z", 50)])
    m = mix_sources(d, goals(spark, [("a", 0.5, 1), ("b", 0.4, 2), ("none", 0.1, 3)]))
    r = {x.source: x for x in m.report.collect()}
    assert not r["b"].reachable and not r["none"].reachable and r["b"].chosen_rows == 10 and r["none"].chosen_tokens == 0
    assert {x.source for x in m.chosen.collect()} == {"a", "b"} and max(x.copy for x in m.chosen.collect() if x.source == "b") == 2


def test_dirt(spark):
    d = docs(spark, [("a", 20), (None, 5)]).unionByName(spark.createDataFrame([(900, "a", None, 1, 1, 1.0), (901, "a", "", 1, 1, 1.0), (None, "a", "some text", 1, 1, 1.0), (0, "a", "same id", 1, 1, 1.0)], D))
    g = goals(spark, [("a", 2.0, None), ("a", 2.0, None), (None, 1.0, 1), ("b", 0.0, 1), ("c", None, 1), ("d", float("nan"), 1), ("e", 2.0, -1)])
    r = {x.source: x for x in mix_sources(d, g).report.collect()}
    assert set(r) == {"a", "e"} and r["a"].target_share == 0.5 and r["a"].max_repeats == 1 and r["a"].chosen_rows == 22
    empty = mix_sources(d.limit(0), g)
    assert empty.chosen.count() == 0 and empty.report.count() == 2 and mix_sources(d, g.limit(0)).report.count() == 0


@pytest.mark.parametrize("budget", [10, 100, 180, 500])
def test_finish_line(budget):
    queues = [(0.5, 100, 1), (0.3, 20, 2), (0.2, 40, 1)]
    v = finish_line(queues, budget)
    given = sum(min(w * v, t * r) for w, t, r in queues)
    assert abs(given - min(budget, 180)) < 1e-6
