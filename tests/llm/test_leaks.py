import itertools
import random

import numpy as np

from tidemark.llm.leaks import SHINGLE, aligned, leaked_items, prefix_reach, straight
from tidemark.llm.words import words

WORDS = [a + b for a in ("zor", "bel", "qui", "tan", "mev", "lor", "pid") for b in ("ka", "mi", "dan", "fex", "or", "ul")]


def item(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, code int"), spark.createDataFrame([(i, t, "a") for i, t in items], "item_id long, item_text string, doc string")


def found(spark, docs, items, **more):
    return {(r.doc, r.item) for r in leaked_items(*frames(spark, docs, items), **more).collect()}


def brute(text, target, span=18, rate=7):
    """Whether some stretch of the item lies on one diagonal with few enough other words between matching ends."""
    t, w = words(text), words(target)
    for shift in range(-len(w), len(t)):
        ok = [0 <= i + shift < len(t) and t[i + shift] == w[i] for i in range(len(w))]
        for a in range(len(w)):
            for b in range(a + span, len(w) + 1):
                if ok[a] and ok[b - 1] and ok[a:b].count(False) * rate <= b - a:
                    return True
    return False


def test_disguises(spark):
    w = item(1).split()
    part = w[10:30]
    docs = {
        1: "intro " + " ".join(part) + " outro", 2: " ".join(part).upper(), 3: "> " + "\n> ".join(" ".join(part[i : i + 4]) for i in range(0, 20, 4)), 4: " ".join(f"<b>{x}</b>" for x in part), 5: "&nbsp;".join(part),
        6: " ".join(x[:2] + "​" + x[2:] for x in part), 7: '{"t": "' + "\\n".join(part) + '"}', 8: " ".join(part[:10]) + "\n\n# %% [code] In [3]\n" + " ".join(part[10:]), 9: "dataset.append('" + ", ".join(part) + "')",
        10: " ".join(part[:9]) + " " + part[9][:3] + "-\n" + part[9][3:] + " " + " ".join(part[10:]), 11: " ".join(part[:6] + ["other"] + part[7:13] + ["word"] + part[14:]), 12: " ".join(part[:6] + part[7:]), 13: " ".join(part[:6] + ["more"] + part[6:]),
        20: " ".join(part[:15]), 21: " ".join(reversed(part)), 22: " ".join(part[:6] + ["a", "b", "c", "d"] + part[10:]), 23: None, 24: "", 25: item(99),
    }
    assert found(spark, docs.items(), [(7, " ".join(w)), (8, None), (9, "too short"), (None, " ".join(w))]) == {(k, 7) for k in range(1, 14)}


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    items = [(k, item(k, 40)) for k in range(6)]
    docs = []
    for d in range(60):
        k = rnd.randrange(6)
        w = items[k][1].split()
        a = rnd.randrange(20)
        part = w[a : a + rnd.randrange(10, 32)]
        for _ in range(rnd.randrange(5)):
            part[rnd.randrange(len(part))] = rnd.choice(WORDS)
        docs.append((d, item(1000 + d, 15) + " " + " ".join(part) + " " + item(2000 + d, 15)))
    want = {(d, k) for d, t in docs for k, x in items if brute(t, x)}
    assert want <= found(spark, docs, items) and len(want) > 10
    extra = found(spark, docs, items) - want  # only what needs a shift of the diagonal may come on top
    assert len(extra) <= 0.1 * len(want)
    assert found(spark, docs, items, items_per_block=2) == found(spark, docs, items)


def test_copies_repeats_and_empty(spark):
    t = item(3)
    docs = [(1, t), (2, t), (1, t), (3, (t + " ") * 50), (None, t)]
    assert found(spark, docs, [(1, t), (1, t), (2, t)]) == {(d, i) for d in (1, 2, 3) for i in (1, 2)}
    assert found(spark, [], [(1, t)]) == set() and found(spark, docs, []) == set()
    assert found(spark, [(1, "b64 " + "QUJD" * 200_000 + " " + t)], [(1, t)]) == {(1, 1)}


def test_alignment():
    a = np.arange(1, 41)
    assert aligned(a, a, np.array([0]), 18, 7) == 18
    assert aligned(np.r_[a[:17], 99, 99, 99], a, np.array([0]), 18, 7) == 0
    assert aligned(np.array([5, 6]), a, np.array([-4]), 18, 7) == 0


def test_copies_don_t_hide_an_altered_passage(spark):
    w = [f"{a}{b}" for a in ("zor", "bel", "qui", "tan", "mev") for b in ("ka", "mi", "dan", "fex", "or", "ul")][:21]
    part = ["other" if k in (5, 10, 15) else x for k, x in enumerate(w)]  # shingles 0 and 16 stay
    for copies in (0, 1, 3):
        docs = [(0, " ".join(part)), *[(k + 1, " ".join(w)) for k in range(copies)]]
        assert found(spark, docs, [(7, " ".join(w))]) == {(d, 7) for d, _ in docs}


def test_reach_against_every_way_to_alter():
    worst = 0
    for n in range(18, 24):
        for k in range(n // 7 + 1):
            for bad in itertools.combinations(range(1, n - 1), k):
                intact = [p for p in range(n - SHINGLE + 1) if not any(p <= b < p + SHINGLE for b in bad)]
                worst = max(worst, min(b - a for a, b in itertools.pairwise(intact)))
    assert worst == prefix_reach(18, 7) == 16
    assert prefix_reach(18, 6) is None and prefix_reach(18, 4) is None


def test_lax_rate_keeps_every_shingle(spark):
    w = item(11, 18).split()
    part = ["other" if k in (5, 12) else x for k, x in enumerate(w)]
    docs = [(0, " ".join(part)), (1, " ".join(w)), (2, " ".join(w))]
    assert found(spark, docs, [(7, " ".join(w))], rate=6) == {(d, 7) for d in range(3)}


def test_straight_accepts_what_counting_accepts():
    rng = np.random.default_rng(4)
    for _ in range(300):
        match = rng.random((3, 40)) < rng.uniform(0.5, 0.95)
        want = any(
            row[a] and row[b] and b - a + 1 >= 18 and 7 * int((~row[a : b + 1]).sum()) <= b - a + 1
            for row in match for a in range(40) for b in range(a, 40)
        )
        assert straight(match, 18, 7) == want


def test_altered_passages_among_many_copies_of_some_parts(spark):
    rnd = random.Random(9)
    for k in range(4):
        w = item(50 + k, 45).split()
        docs = []
        for d in range(40):  # skewed: some stretches of the item are far commoner than others
            a = rnd.choice([0, 0, 0, 12, 24])
            part = w[a : a + 21]
            for b in rnd.sample(range(1, 20), rnd.randrange(4)):
                part[b] = rnd.choice(WORDS)
            docs.append((d, item(900 + d, 10) + " " + " ".join(part) + " " + item(800 + d, 10)))
        want = {(d, 1) for d, t in docs if brute(t, " ".join(w))}
        assert want <= found(spark, docs, [(1, " ".join(w))])
