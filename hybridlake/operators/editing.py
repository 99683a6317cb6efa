"""Finding and replacing a block of text whose whitespace may differ."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


def normal_lines(text: str) -> list[str]:
    """Non-blank lines without blanks around them, runs of blanks as one."""
    return [re.sub(r"\s+", " ", s) for s in map(str.strip, text.split("\n")) if s]


def find_block(text: str, block: str) -> tuple[int, int] | None:
    """(start, end) of the first window of as many lines as the block has whose normal lines are the block's."""
    want = normal_lines(block)
    if not want:
        return None
    lines, height = text.split("\n"), block.count("\n") + 1
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    for i in range(len(lines) - height + 1):
        if normal_lines("\n".join(lines[i : i + height])) == want:
            return starts[i], starts[i + height] - 1
    return None


def replace_block(text: str, old: str, new: str) -> tuple[str | None, str]:
    """(text with the first exact, else loose, occurrence replaced; how it was found: exact, loose or missing)."""
    if old and (at := text.find(old)) >= 0:
        return text[:at] + new + text[at + len(old) :], "exact"
    if span := find_block(text, old):
        return text[: span[0]] + new + text[span[1] :], "loose"
    return None, "missing"


def find_blocks(df: DataFrame, key: Column, text: Column, block: Column) -> DataFrame:
    """(key, start, end) of the block found in each text."""
    picked = df.select(key.alias("key"), text.alias("t"), block.alias("b")).where("t is not null and b is not null")
    kind = picked.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [(k, find_block(t, b)) for k, t, b in zip(pdf["key"], pdf["t"], pdf["b"], strict=True)]
            yield pd.DataFrame([(k, *s) for k, s in spans if s], columns=["key", "start", "end"])

    return picked.mapInPandas(run, f"key {kind}, start int, end int")
