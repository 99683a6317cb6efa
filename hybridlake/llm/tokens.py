"""Token counts by a public tokenizer's rank file, whose path is a parameter."""

from __future__ import annotations

import base64
import re
import sys
import types
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

#: Fixed value: the public pattern that splits text before byte-pair merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longer texts are encoded in stretches of at least this length, cut where no token can cross.
STRETCH = 20_000
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A blank after another character: the pattern ends a token before it, whatever stands around.
_CUT = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
#: Runs of blanks that the pattern would try to match by recursion.
_LONG_SPACE = re.compile(f"[{_SPACE}]{{2000,}}")


def encoding(path: str):
    """The byte-pair encoding of a rank file, loaded once per Python process."""
    # This module's own globals are copied to workers with each task; sys.modules outlives tasks.
    cache = sys.modules.setdefault("_token_encodings", types.ModuleType("_token_encodings")).__dict__
    if path not in cache:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        cache[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache[path]


def count_tokens(text: str | None, path: str = DEFAULT_RANKS) -> int:
    """Tokens of the whole text, as if encoded at once; 0 for null and empty."""
    if not text:
        return 0
    e = encoding(path)
    if len(text) <= STRETCH:
        return len(e.encode_ordinary(text)) if not _LONG_SPACE.search(text) else _count_spaced(e, text)
    total = start = 0
    while start < len(text):
        m = _CUT.search(text, start + STRETCH)
        end = m.start() if m else len(text)
        total += _count_spaced(e, text[start:end])
        start = end
    return total


def _count_spaced(e, text: str) -> int:
    """Tokens of a text whose long runs of blanks are pieces: all but the last blank of a run, or all at the text's end."""
    total = at = 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        total += len(e.encode_ordinary(text[at : m.start()])) + len(e._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(e.encode_ordinary(text[at:]))


def with_token_counts(df: DataFrame, columns: dict[str, Column], text: Column, path: str = DEFAULT_RANKS) -> DataFrame:
    """The named columns and n_tokens (int), text left out; the tokenizer runs once per row in Arrow batches."""
    picked = df.select(*[c.alias(n) for n, c in columns.items()], text.alias("_text"))
    fields = [f for f in picked.schema.fields if f.name != "_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["n_tokens"] = [count_tokens(t, path) for t in pdf.pop("_text")]
            yield pdf

    return picked.mapInPandas(run, schema)
