import base64
import random

import numpy as np

from tidemark.llm.toxicity import Network, fit_classifier, line_key, line_words, padded, rates, score_documents, score_lines

GOOD = ["plot the weekly spread", "kill the process before restart", "print frame shape", "the master and slave replica", "we smooth the series and keep a copy", "drop missing rows first"]
BAD = {"abuse": ["you are a stupid glorp", "shut up you glorp"], "hate": ["all vreks are vermin", "send the vreks away vermin"], "sexual": ["show me your znork", "wet znork all night"]}


def corpus(n, seed, toxic=0.3):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lines = [rnd.choice(GOOD) + f" {rnd.randrange(99)}" for _ in range(12)]
        kind = rnd.choice(sorted(BAD)) if rnd.random() < toxic else None
        if kind:
            lines.insert(rnd.randrange(12), rnd.choice(BAD[kind]))
        docs.append((i, "\n".join(lines), rnd.choice(["en", "EN", None]), rnd.choice("pq"), "x", True))
        labels += [(2 * i, i, "r1", kind or "none"), (2 * i + 1, i, "r2", kind or "none")]
    return docs, labels


D, L = "doc_id long, text string, lang string, source string, score string, flagged boolean", "label_id long, doc_id long, rater string, label string"


def test_disguises_read_alike():
    plain = line_words("you stupid glorp")
    for text in ("YOU STUPID GLORP!!!", "y0u $tup1d gl0rp", "yоu stuрid glоrр", "you s t u p i d glorp", "yoooou stuuupid gloorp", "you stu​pid glorp", "you \\u0073tupid glorp"):
        assert line_words(text) == plain, text
    assert line_words("lag_4 = 17") == ["lag", "0", "0"] and line_words("") == []
    assert line_key("a 12.5 b 7") == line_key("a 3 b 44") and line_key("x " + base64.b64encode(bytes(range(128, 218))).decode()) == "x  data"


def test_joined_and_encoded_words_are_read():
    plain = line_words("you are a worthless idiot and everybody here knows it by now please")
    joined = "you are a worthless idiot and everybody here knows it by now please".split()
    for run in ("_".join(joined), "-".join(joined), "/".join(joined), "".join(w.title() for w in joined), base64.b64encode(" ".join(joined).encode()).decode(), base64.urlsafe_b64encode(" ".join(joined).encode()).decode()):
        assert line_words(line_key(run)) == plain, run
    assert line_words("x" + "ab" * 30) == ["x" + "ab" * 30]
    assert "data" in line_key("a" * 3 + "0f9e8d7c" * 10)


def test_gradient():
    rng = np.random.default_rng(0)
    net = Network.fresh(0)
    net = Network(net.embed.astype(float), [b.astype(float) for b in net.banks], [b.astype(float) for b in net.biases], net.dense.astype(float), net.shift.astype(float))
    ids = rng.integers(2, 50, (6, 9))
    target = rng.random((6, 3))
    loss = lambda: float((((net.forward(ids)[0]) - target) ** 2).sum() / 2)
    logits, kept = net.forward(ids)
    grads = net.backward(ids, kept, logits - target)
    for value, grad in zip(net.parts(), grads, strict=True):
        flat, g = value.reshape(-1), grad.reshape(-1)
        for k in np.argsort(-np.abs(g))[:3]:
            old = flat[k]
            flat[k] = old + 1e-6
            up = loss()
            flat[k] = old - 1e-6
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-6 - g[k]) < 1e-4 * abs(g[k]) + 1e-4


def test_long_lines_are_scored_whole():
    table, owner = padded([[5] * 200, [], [6]])
    assert len(table) == 5 + 1 + 1 and owner.tolist() == [0] * 5 + [1, 2]
    assert score_lines(Network.fresh(1), [[], [5] * 200]).shape == (2, 3)


def test_held_out_accuracy_and_rates(spark):
    docs, labels = corpus(240, 1)
    truth = {d for _, d, _, k in labels if k != "none"}
    known = [x for x in labels if x[1] < 160]
    out = score_documents(spark.createDataFrame(docs, D), spark.createDataFrame(known, L)).cache()
    said = {r.doc for r in out.where("flagged").collect()}
    new = set(range(160, 240))
    assert len(said & truth & new) >= 0.9 * len(truth & new) and len((said - truth) & new) <= 0.05 * 80
    assert out.count() == 240 and sum(r.documents for r in rates(out).collect()) == 240
    best = {r.doc: max(("abuse", r.abuse), ("hate", r.hate), ("sexual", r.sexual), key=lambda p: p[1])[0] for r in out.where("flagged").collect()}
    kinds = {d: k for _, d, _, k in labels}
    right = [best[d] == kinds[d] for d in best if d in truth]
    assert np.mean(right) > 0.9


def test_dirt(spark):
    docs, labels = corpus(60, 2)
    odd = [(900, None, None, None, None, None), (901, "", "en", "p", None, None), (902, " \n ", "xx", "p", None, None), (None, "you are a stupid glorp", "en", "p", None, None), (903, "you are a stupid glorp " * 3000, "en", "p", None, None), docs[0]]
    bad_labels = [(5000, 1, "r", None), (5001, None, "r", "abuse"), (5002, 99999, "r", "abuse"), labels[0]]
    out = score_documents(spark.createDataFrame(docs + odd, D), spark.createDataFrame(labels + bad_labels, L)).collect()
    by = {r.doc: r for r in out}
    assert len(out) == 66 and not by[900].flagged and not by[901].flagged and not by[902].flagged and by[903].flagged
    none = score_documents(spark.createDataFrame(docs, D), spark.createDataFrame([], L)).collect()
    assert len(none) == 60 and not any(r.flagged for r in none)
    assert score_documents(spark.createDataFrame([], D), spark.createDataFrame(labels, L)).count() == 0


def test_nothing_to_learn():
    assert not fit_classifier([], []).thresholds
