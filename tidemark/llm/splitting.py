"""Splitting oversized texts at natural boundaries, with overlap.

Structure-tree packing: a text is a tree of sections, sub-sections and list items, paragraphs, lines, sentences and words.
Only nodes over the limit are taken apart; the parts of a node are merged again, left to right, as far as the limit allows,
and the result goes up to the parent, where it is merged with its neighbours in turn. Each level is found by one linear scan
of the oversized node, so a text costs time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Starts of nodes, from coarse to fine. A boundary lies before a match; for the last three levels, after it.
BEFORE = (
    re.compile(r"(?m)\f|^(?:[ \t]*-{2,}\s*page\b|[ \t]*#{1,2}\s|[ \t]*(?:ARTICLE|SECTION|Article|Section|CHAPTER|Chapter|PART|Part|SCHEDULE|Schedule|ANNEX|Annex|Artikel|Titre|Anhang)\s+[\dIVXLC]+|[ \t]*§\s*\d|[ \t]*\d+[.)]\s+\S|[ \t]*[IVXLC]+\.\s+\S|[ \t]*[A-Z][A-Z &/-]{5,}$|<h[1-3]\b)"),
    re.compile(r"(?m)^(?:[ \t]*#{3,6}\s|[ \t]*\d+(?:\.\d+)+[.)]?\s|[ \t]*\(?(?:[a-z]|[ivx]+|\d+)\)\s|<h[4-6]\b)"),
    re.compile(r"(?m)^[ \t]*(?:[-*•–]\s|\|)|<(?:li|p|tr)\b"),
)
AFTER = (
    re.compile(r"(?:\r\n|\r|\n)(?:[ \t]*(?:\r\n|\r|\n))+|\f"),
    re.compile(r"\r\n|\r|\n|\f"),
    re.compile(r"[.!?…。！？;]+[\"'”’)\]]*(?=\s|$|---)|[。！？]"),
    re.compile(r"\s+"),
)
SENTENCE_END = re.compile(r"[.!?…。！？;:][\"'”’)\]]*\s*\Z")
#: Boundary names by level, as given out in the column ends_at.
LEVELS = ("section", "subsection", "item", "paragraph", "line", "sentence", "word", "character")


def _cuts(text: str, start: int, end: int, level: int) -> list[int]:
    """Inner boundaries of one level in text[start:end]."""
    if level < len(BEFORE):
        found = (m.start() for m in BEFORE[level].finditer(text, start, end))
    else:
        found = (m.end() for m in AFTER[level - len(BEFORE)].finditer(text, start, end))
    return [p for p in found if start < p < end]


def pack(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """End of every piece and the level of its boundary. Pieces after the first have room for limit - overlap new characters."""
    n = len(text)
    if n <= limit:
        return [(n, -1)]
    room = limit - overlap
    # Work list instead of recursion. Nodes come out in order; units are maximal subtrees within the limit, or merged ones.
    ends: list[tuple[int, int]] = []
    units: list[tuple[int, int, int]] = []  # start, end, level of the boundary at its end
    stack = [(0, n, 0, -1)]
    while stack:
        start, end, level, closing = stack.pop()
        if end - start <= room:
            units.append((start, end, closing))
            continue
        if level == len(LEVELS) - 1:
            points = list(range(start + room, end, room))
        else:
            points = _cuts(text, start, end, level)
        nodes = list(zip([start, *points], [*points, end], strict=True))
        if len(nodes) == 1:
            stack.append((start, end, level + 1, closing))
            continue
        # Siblings that fit together are one node; an oversized one stays alone and is taken apart in its turn.
        merged: list[list[int]] = []
        for a, b in nodes:
            if merged and b - merged[-1][0] <= room and merged[-1][1] - merged[-1][0] <= room:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        for k in range(len(merged) - 1, -1, -1):
            a, b = merged[k]
            stack.append((a, b, level + 1, closing if k == len(merged) - 1 else level))
    # On the way up: neighbours of different parents are merged too while the piece has room; the first piece has the whole
    # limit. A piece ends at the strongest boundary of its last half, the last one of those.
    begin = k = 0
    while begin < n:
        space = room if ends else limit
        best = k
        while k < len(units) and units[k][1] - begin <= space:
            if units[k][1] - begin <= space // 2 or _weakness(text, units[k]) <= _weakness(text, units[best]) or units[best][1] - begin <= space // 2:
                best = k
            k += 1
        if k == len(units):
            best = k - 1
        ends.append((units[best][1], units[best][2]))
        begin, k = units[best][1], best + 1
    return ends


def _weakness(text: str, unit: tuple[int, int, int]) -> float:
    """Level of the boundary at a unit's end; a line's end within a sentence comes after the sentence's end."""
    level = unit[2]
    if LEVELS[level] == "line" and not SENTENCE_END.search(text, max(unit[0], unit[1] - 20), unit[1]):
        return LEVELS.index("sentence") + 0.5
    return level


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, str, str]]:
    """(number from 1, start, text, boundary) of each piece."""
    out, before = [], 0
    for k, (end, level) in enumerate(pack(text, limit, overlap), 1):
        start = max(0, before - overlap) if k > 1 else 0
        out.append((k, start, text[start:end], LEVELS[level] if level >= 0 else "end"))
        before = end
    return out


def cut_stretch(text: str, end: int) -> int:
    """Length of the stretch without line feed, carriage return or form feed that the cut at end goes through; 0 at a line's end."""
    if end in (0, len(text)) or text[end - 1] in "\n\r\f" or text[end] in "\n\r\f":
        return 0
    begin = max(text.rfind(c, 0, end) for c in "\n\r\f") + 1
    stops = [p for p in (text.find(c, end) for c in "\n\r\f") if p >= 0]
    return min(stops, default=len(text)) - begin


def split_texts(documents: DataFrame, doc_id: str, text: str, limit: int = 8000, overlap: int = 200) -> DataFrame:
    """doc, piece, start, piece_text, ends_at, through (length of the line its end cuts through; 0 where it ends with a line).

    Pieces are in order, at most limit characters (code points) long, start 0-based, and each repeats the last overlap
    characters of the one before; leaving the overlaps out gives the text back. ends_at is 'end' or the kind of boundary.
    Texts within the limit, blank ones included, are one piece; NULL and empty texts give none. Rows are handled each for
    itself, so repeated rows give repeated pieces; a NULL id stays NULL.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    kind = documents.schema[doc_id].dataType.simpleString()
    source = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = [(row, *p, cut_stretch(t, p[1] + len(p[2]))) for row, t in enumerate(part.column(1).to_pylist()) for p in pieces(t, limit, overlap)]
                columns = [list(c) for c in zip(*rows, strict=True)]
                kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64())
                arrays = [part.column(0).take(pa.array(columns[0])), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "piece", "start", "piece_text", "ends_at", "through"])

    return source.mapInArrow(run, f"doc {kind}, piece int, start long, piece_text string, ends_at string, through long")
