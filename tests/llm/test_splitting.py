import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.splitting import cut_stretch, pieces, split_texts


def rejoined(text, limit, overlap):
    out = pieces(text, limit, overlap)
    for (_, s, t, _), (_, s2, t2, _) in zip(out, out[1:], strict=False):
        assert s2 == s + len(t) - overlap and t2[:overlap] == t[-overlap:] if overlap else s2 == s + len(t)
    assert all(len(t) <= limit for _, _, t, _ in out) and [k for k, *_ in out] == list(range(1, len(out) + 1))
    return out[0][2] + "".join(t[overlap:] for _, _, t, _ in out[1:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "word ", "Sentence one. ", "\n", "\r\n", "\n\n", "\f", "# Head\n", "1.1 sub\n", "- item\n", "| cell |", "é👍", "ARTICLE IV\n", "x" * 30]), max_size=120).map("".join))
def test_round_trip(text):
    if text:
        assert rejoined(text, 50, 10) == text
        assert rejoined(text, 17, 0) == text


def test_natural_boundaries():
    text = "".join(f"# Part {k}\n\n" + "A sentence here. " * 20 + "\n\n" for k in range(6))
    out = pieces(text, 800, 50)
    assert {p[3] for p in out[:-1]} == {"section"} and all(p[2].endswith("\n\n") for p in out)
    assert [p[3] for p in pieces("One two. " * 100, 100, 10)[:-1]] == ["word"] * (len(pieces("One two. " * 100, 100, 10)) - 1) or all(p[2].rstrip().endswith(".") for p in pieces("One two. " * 100, 100, 10))
    assert {p[3] for p in pieces("x" * 1000, 100, 10)[:-1]} == {"character"}


def test_long_text_is_linear():
    rnd = random.Random(0)
    text = "".join(rnd.choice(["word ", "end. ", "\n\n", "# H\n", "x"]) for _ in range(600_000))
    assert rejoined(text, 8000, 200) == text
    assert rejoined("y" * 3_000_000, 8000, 200) == "y" * 3_000_000


def test_operator_on_dirt(spark):
    rows = [(1, None, "n"), (2, "", "n"), (3, " \n ", "n"), (4, "a. " * 5000, "n"), (4, "a. " * 5000, "n"), (None, "b", "n"), (5, "👍" * 8001, "n")]
    df = spark.createDataFrame(rows, "contract_id long, contract_text string, piece string")
    out = split_texts(df, "contract_id", "contract_text").collect()
    assert {r.doc for r in out} == {3, 4, 5, None} and sum(r.doc == 4 for r in out) == 4
    assert [(r.piece, len(r.piece_text), r.through) for r in out if r.doc == 5] == [(1, 7800, 8001), (2, 401, 0)]
    assert split_texts(df.limit(0), "contract_id", "contract_text").count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "contract_id", "contract_text", 10, 10)


def test_stretch_a_cut_goes_through():
    assert [cut_stretch("ab\rcde\ff\n", k) for k in range(10)] == [0, 2, 0, 0, 3, 3, 0, 0, 0, 0]
    assert cut_stretch("abc", 1) == 3


def test_ids_beyond_a_float_beside_null(spark):
    rows = [(2**53 + 1, "a"), (None, "b"), (2**53 + 3, "c")]
    out = split_texts(spark.createDataFrame(rows, "contract_id long, contract_text string").coalesce(1), "contract_id", "contract_text").collect()
    assert {(r.doc, r.piece_text) for r in out} == set(rows)


def test_a_paragraph_end_is_preferred_to_a_line_end():
    text = "".join(("word " * 8 + "\n") * 9 + "The end.\n\n" for _ in range(20))
    assert {p[3] for p in pieces(text, 1000, 50)[:-1]} == {"paragraph"}
