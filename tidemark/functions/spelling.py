"""Spellings of a label reduced to the label they stand for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, or most + 1 if more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            now[j] = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], before[j - 2] + 1)
        before, last = last, now
    return min(last[-1], most + 1)


def bare_spelling(text: str | None, fillers: tuple[str, ...] = ()) -> str | None:
    """The letters and digits of a spelling, without case, accents and filler words; None for blank."""
    if text is None or not text.strip():
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(c))
    words = "".join(c if c.isalnum() else " " for c in plain).split()
    return "".join(w for w in words if w not in fillers) or "".join(words) or text.strip()


def label_key(text: str | None, labels: tuple[str, ...], fillers: tuple[str, ...]) -> str | None:
    """The label a spelling stands for; the bare spelling where none is near; None for blank.

    Case, accents, punctuation, spaces and filler words don't count; up to a third of a label's letters (one edit in three,
    at most two) may differ, a swap of neighbours being one edit. Of equally near labels the first in the list is taken.
    """
    bare = bare_spelling(text, fillers)
    if bare is None or not labels or not any(c.isalnum() for c in bare):
        return bare
    best = min((edit_distance(bare, label, 2), k) for k, label in enumerate(labels))
    return labels[best[1]] if best[0] <= min(2, max(1, len(labels[best[1]]) // 3)) else bare


def keys_of(column: Column, labels: tuple[str, ...], fillers: tuple[str, ...]) -> Column:
    """label_key of a column, worked out once per distinct spelling of a batch."""

    @F.pandas_udf("string")
    def key(texts: pd.Series) -> pd.Series:
        known = {t: label_key(t, labels, fillers) for t in texts.dropna().unique()}
        return texts.map(lambda t: known.get(t))

    return key(column)
