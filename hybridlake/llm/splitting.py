"""Splitting of oversized texts at natural boundaries, with overlap.

A text is cut along a hierarchy of boundaries: sections (headings, rules), paragraphs (blank
lines), lines and sentences, words, characters. A part that fits is kept whole; only a part that
doesn't is cut at the next finer level. Parts are then packed greedily: a piece takes parts until the next
one would pass the limit, and ends at the coarsest boundary of its second half. A piece begins with up to `overlap` characters of the end
of the one before, from the first sentence, else word, that starts there.

Bodies of the pieces (without overlap) tile the text: joined, they give it back exactly. Lengths
are Unicode code points. A line end of two characters and a letter with its combining marks stay
together where a boundary can be moved by up to 32 characters.

Defined results: null texts and texts within the limit give no pieces; very long texts without any
boundary are cut by characters; texts are read whole, one at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each level's boundaries lie at the end of a match.
LEVELS = tuple(
    re.compile(p, re.M)
    for p in (
        r"(?:\r\n|\r|\n)+(?=[ \t]*(?:#{1,6}[ \t]|={3,}|-{3,}[ \t]*$|\*{3,}[ \t]*$))|\f",
        r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*",
        r"(?:\r\n|\r|\n)+|[.!?…](?:[\"')\]»”]*)[ \t]+|[。！？]",
        r"\s+",
    )
)


def _joined(text: str, at: int) -> bool:
    """Whether a cut at this place would split a line end or a letter from its marks."""
    return (text[at] == "\n" and text[at - 1] == "\r") or unicodedata.combining(text[at]) > 0


def _safe(text: str, cut: int, least: int) -> int:
    """cut, moved back so that it splits no line end and no combined letter."""
    at = cut
    while max(least, cut - 32) < at < len(text) and _joined(text, at):
        at -= 1
    return at if at > least else cut


def atoms(text: str, start: int, end: int, room: int, level: int = 0, outer: int = 0) -> Iterator[tuple[int, int]]:
    """(end, level of the boundary there) of consecutive parts of text[start:end], none longer than room."""
    if end - start <= room:
        yield end, outer
        return
    if level == len(LEVELS):
        while end - start > room:
            start = _safe(text, start + room, start)
            yield start, level
        yield end, outer
        return
    last = start
    for m in LEVELS[level].finditer(text, start, end):
        if last < m.end() < end:
            yield from atoms(text, last, m.end(), room, level + 1, level)
            last = m.end()
    yield from atoms(text, last, end, room, level + 1, outer)


def overlap_start(text: str, piece_start: int, end: int, overlap: int) -> int:
    """Where the repeated tail of text[piece_start:end] begins."""
    low = max(piece_start, end - overlap)
    if low >= end or overlap <= 0:
        return end
    if low == piece_start:
        return low
    for level in (LEVELS[2], LEVELS[3]):
        m = level.search(text, max(piece_start, low - 1), end)
        if m and low <= m.end() < end:
            return m.end()
    at = low
    while at < end and _joined(text, at):
        at += 1
    return at


def split_text(text: str, limit: int = 2500, overlap: int = 400) -> list[tuple[int, int, int]]:
    """(start, body start, end) of each piece; text[start:end] has at most `limit` characters."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    pieces: list[tuple[int, int, int]] = []
    start = body = 0
    ends: list[tuple[int, int]] = []  # boundaries taken since body
    for stop, level in atoms(text, 0, len(text), limit - overlap):
        while ends and stop - start > limit:
            # The coarsest boundary of the piece's second half, the last of several; else the last one.
            late = [(-lv, e) for e, lv in ends if e - start > limit // 2]
            cut = max(late)[1] if late else ends[-1][0]
            pieces.append((start, body, cut))
            ends = [x for x in ends if x[0] > cut]
            tail = overlap_start(text, start, cut, overlap)
            first = ends[0][0] if ends else stop
            start, body = (tail, cut) if first - tail <= limit else (cut, cut)
        ends.append((stop, level))
    if ends and ends[-1][0] > body:
        pieces.append((start, body, ends[-1][0]))
    return pieces


def split_oversized(df: DataFrame, table: Column, key: Column, text: Column, *, limit: int = 2500, overlap: int = 400) -> DataFrame:
    """Pieces of the texts longer than `limit`: (table_name, item_key, piece_no from 0, body_start, n_overlap, piece).

    Short texts are dropped in the JVM, before Python sees any.
    """
    big = df.select(table.alias("table_name"), key.alias("item_key"), text.alias("text")).where(F.length("text") > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cuts = [split_text(t, limit, overlap) for t in pdf["text"]]
            rows = np.repeat(np.arange(len(pdf)), [len(c) for c in cuts])
            flat = [c for each in cuts for c in each]
            yield pd.DataFrame({
                "table_name": pdf["table_name"].to_numpy()[rows], "item_key": pdf["item_key"].to_numpy()[rows], "piece_no": [i for c in cuts for i in range(len(c))], "body_start": [b for _, b, _ in flat],
                "n_overlap": [b - s for s, b, _ in flat], "piece": [t[s:e] for t, each in zip(pdf["text"], cuts, strict=True) for s, _, e in each],
            })

    return big.mapInPandas(run, "table_name string, item_key string, piece_no int, body_start int, n_overlap int, piece string")
