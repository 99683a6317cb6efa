"""Splitting of documents into overlapping chunks for retrieval, as a table function.

Paragraphs are merged while they fit. A chunk that follows another begins with the tail of it, from
the first sentence end or line end in the tail (else the first blank). A paragraph that is too
long by itself is cut after the last mark of the first kind that has one in the second half of the
limit, else at the limit; the next piece begins with the tail of the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

# Cut marks in order of preference.
TEXT_MARKS = (".", "\n", ">", "}", ";")
PAGE_MARKS = (".", "\n", " ")


def _tail(text: str, overlap: int, marks: tuple[str, ...]) -> str:
    """The end of the text that the next chunk repeats."""
    last = text[-overlap:] if overlap else ""
    places = [p for p in map(last.find, marks) if p >= 0]
    start = min(places) if places else last.find(" ")
    return last[start + 1 :].strip()


def _glue(tail: str, text: str) -> str:
    return f"{tail}\n\n{text}" if tail else text


def chunks(text: str | None, limit: int = 2500, overlap: int = 400, marks: tuple[str, ...] = TEXT_MARKS) -> list[str]:
    """The chunks of a text; a text within the limit is its own only chunk, null is the empty one."""
    if text is None or len(text) <= limit or text.isspace():
        return [text or ""]
    out: list[str] = []
    now = ""
    for paragraph in filter(None, map(str.strip, text.split("\n\n"))):
        if len(joined := _glue(now, paragraph)) <= limit:
            now = joined
            continue
        if now.strip():
            out.append(now)
        now = _glue(_tail(out[-1], overlap, marks[:2]) if out else "", paragraph)
        while len(now) > limit:
            places = (now.rfind(m, 0, limit) for m in marks)
            cut = next((p + 1 for p in places if p > limit // 2), limit)
            head, rest = now[:cut], now[cut:]
            out.append(head)
            now = _glue(_tail(head, overlap, marks), rest).strip()
    if now.strip():
        out.append(now)
    return out or [text]


def chunk_lines(source: str, parts: list[str]) -> list[tuple[int, int]]:
    """(first line, last line) of each chunk, found by a stretch from its middle, searched from where the last one was."""
    total, at, out = source.count("\n") + 1, 0, []
    for part in parts:
        found = source.find(part[100:150] if len(part) > 150 else part[:50], max(0, at - 500))
        if found >= 0:
            first, at = source.count("\n", 0, found) + 1, found + len(part) // 2
        else:
            first = min(out[-1][1], total) if out else 1
        out.append((first, min(first + part.count("\n"), total)))
    return out


def chunk_table(df: DataFrame, key: Column, text: Column, *, limit: int = 2500, overlap: int = 400, marks: tuple[str, ...] = TEXT_MARKS) -> DataFrame:
    """(key, chunk_no, first_line, last_line, chunk), in Arrow batches."""
    picked = df.select(key.alias("key"), text.alias("text"))
    kind = picked.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                parts = chunks(t, limit, overlap, marks)
                rows += [(k, i, a, b, p) for i, (p, (a, b)) in enumerate(zip(parts, chunk_lines(t or "", parts), strict=True))]
            yield pd.DataFrame(rows, columns=["key", "chunk_no", "first_line", "last_line", "chunk"])

    return picked.mapInPandas(run, f"key {kind}, chunk_no int, first_line int, last_line int, chunk string")
