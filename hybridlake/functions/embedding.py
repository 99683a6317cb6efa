"""Texts that stand for rows in vector search, and a model-free vector of a text.

Models are functions from a batch of texts to a matrix; `operators.vector.embed` runs them in Arrow batches
and scales to length 1. `hashing_model` counts index tokens by hash: it needs no weights and is the
same everywhere, so vector search can be run and checked without a model.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from hybridlake.functions.text import ACCENTED, BASE


def memory_text(category: Column, content: Column, most: int | None = None) -> Column:
    """`category: ...` and the content on the next line, cut to `most` characters if given."""
    whole = F.concat(F.lit("category: "), F.coalesce(category, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))
    return whole if most is None else F.substring(whole, 1, most)


def skill_text(name: Column, description: Column) -> Column:
    return F.concat_ws(" ", name, description)


def hashing_model(texts: list[str], dims: int = 64) -> np.ndarray:
    """How often tokens of each hash occur in each text; tokens are those of the full-text index."""
    out = np.zeros((len(texts), dims))
    known: dict[str, int] = {}
    fold = str.maketrans(ACCENTED, BASE)
    for row, text in zip(out, texts, strict=True):
        for token in re.split(r"[\W_]+", text.lower().translate(fold)):
            if token:
                at = known.get(token)
                if at is None:
                    at = known[token] = int(hashlib.md5(token.encode()).hexdigest()[:6], 16) % dims
                row[at] += 1
    return out
