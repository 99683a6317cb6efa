"""Filling containers of fixed capacity, balanced by cost.

Items longer than the capacity are cut into full pieces and a rest; all others stay whole. Pieces
are spread over shards by hash (a fixed mean number each, so no shard grows with the corpus), and
within a shard taken in descending size: each goes to the container of least estimated cost
(linear plus quadratic in the tokens of each piece) that has room; where none has, a new one is
opened. A shard starts with as many containers as its tokens fill at best.

Defined results: items of no tokens (null, empty) are left out, they need no room; repeated rows
are separate items; ties are broken by item id; an empty table gives no rows; profiles without a
positive capacity are an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A profile table is a parameter, not data; more rows than this are taken for a mistake.
MOST_PROFILES = 1000


def costs(tokens: np.ndarray, linear: float, quadratic: float) -> np.ndarray:
    return linear * tokens + quadratic * tokens.astype(float) ** 2


def assign(tokens: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> np.ndarray:
    """Container of each piece; tokens are in descending order and at most `capacity`."""
    full = int((tokens == capacity).sum())
    out = np.empty(len(tokens), np.int64)
    out[:full] = np.arange(full)
    rest = tokens[full:]
    bins = max(1, -(-int(rest.sum()) // capacity)) if len(rest) else 0
    room = np.full(max(bins, 16) * 2, -1, np.int64)
    spent = np.zeros(len(room))
    room[:bins] = capacity
    for i, (size, cost) in enumerate(zip(rest.tolist(), costs(rest, linear, quadratic).tolist(), strict=True)):
        fits = np.flatnonzero(room[:bins] >= size)
        if len(fits):
            at = int(fits[np.argmin(spent[fits])])
        else:
            if bins == len(room):
                room, spent = np.concatenate([room, np.full(bins, -1)]), np.concatenate([spent, np.zeros(bins)])
            at, bins = bins, bins + 1
            room[at] = capacity
        room[at] -= size
        spent[at] += cost
        out[full + i] = full + at
    # Containers are emptied into the gaps of fuller ones where all their pieces fit.
    return _close_gaps(out, tokens, capacity, costs(tokens, linear, quadratic))


def _close_gaps(where: np.ndarray, tokens: np.ndarray, capacity: int, cost: np.ndarray) -> np.ndarray:
    """Each moved piece goes to the least gap it fits; of equal gaps, to the container of least cost."""
    n = int(where.max()) + 1 if len(where) else 0
    spent = np.bincount(where, weights=cost, minlength=n)
    used = np.bincount(where, weights=tokens, minlength=n).astype(np.int64)
    by = np.argsort(where, kind="stable")
    first = np.searchsorted(where[by], np.arange(n + 1))
    open_, got = np.ones(n, bool), np.zeros(n, bool)
    for b in np.argsort(used, kind="stable"):
        if got[b] or used[b] == capacity:
            continue
        gap = np.where(open_, capacity - used, -1)
        gap[b] = -1
        if gap[gap > 0].sum() < used[b]:
            break
        moves = []
        for i in by[first[b] : first[b + 1]]:
            fits = np.flatnonzero(gap >= tokens[i])
            if not len(fits):
                break
            least = fits[gap[fits] == gap[fits].min()]
            to = int(least[np.argmin(spent[least])])
            gap[to] -= tokens[i]
            moves.append((i, to))
        else:
            for i, to in moves:
                where[i] = to
                used[to] += tokens[i]
                spent[to] += cost[i]
                got[to] = True
                open_[to] &= used[to] < capacity
            used[b], open_[b] = capacity, False
    return where


def pack(docs: DataFrame, profiles: DataFrame, *, per_shard: int = 4096, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """docs: (item_id, n_tokens), read twice; profiles: (profile, capacity).

    Rows (profile, capacity, shard, container, item_id, piece_no, token_start, n_tokens); a
    container is named by profile, shard and its number. A shard holds `per_shard` pieces on average.
    """
    caps = profiles.limit(MOST_PROFILES + 1).collect()
    if len(caps) > MOST_PROFILES or any(not r["capacity"] or r["capacity"] < 1 for r in caps):
        raise ValueError(f"profiles must be at most {MOST_PROFILES} rows with a positive capacity")
    n_pieces = docs.where("n_tokens > 0").agg(*[F.sum(F.ceil(F.col("n_tokens") / F.lit(int(r["capacity"])))) for r in caps]).first() if caps else []
    kinds = F.array(*[F.struct(F.lit(r["profile"]).alias("profile"), F.lit(int(r["capacity"])).alias("capacity"), F.lit(max(1, -(-int(n or 0) // per_shard))).alias("shards")) for r, n in zip(caps, n_pieces, strict=True)]) if caps else F.array().cast("array<struct<profile:string,capacity:int,shards:int>>")
    pieces = docs.where("n_tokens > 0").select("item_id", "n_tokens", F.explode(kinds).alias("k"))
    pieces = pieces.select("item_id", F.col("n_tokens").alias("all"), "k.profile", "k.capacity", "k.shards", F.explode(F.expr("sequence(0, cast((n_tokens - 1) div k.capacity as int))")).alias("piece_no"))
    pieces = pieces.select(
        "profile", "capacity", F.pmod(F.xxhash64("item_id", "piece_no", "all"), F.col("shards")).cast("int").alias("shard"), "item_id", "piece_no",
        (F.col("piece_no").cast("long") * F.col("capacity")).alias("token_start"),
        F.least(F.col("capacity"), F.col("all") - F.col("piece_no").cast("long") * F.col("capacity")).cast("int").alias("n_tokens"),
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "item_id", "piece_no"], ascending=[False, True, True])
        pdf["container"] = assign(pdf["n_tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]), linear, quadratic)
        return pdf[["profile", "capacity", "shard", "container", "item_id", "piece_no", "token_start", "n_tokens"]]

    id_type = docs.schema["item_id"].dataType.simpleString()
    schema = f"profile string, capacity int, shard int, container long, item_id {id_type}, piece_no int, token_start long, n_tokens int"
    return pieces.groupBy("profile", "shard").applyInPandas(fill, schema)


def report(packed: DataFrame, *, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """Per profile: containers used, the least number possible by volume, fill, and largest cost over mean cost."""
    cost = F.lit(linear) * F.col("n_tokens") + F.lit(quadratic) * F.col("n_tokens").cast("double") ** 2
    each = packed.groupBy("profile", "capacity", "shard", "container").agg(F.sum("n_tokens").alias("used"), F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("items"))
    return each.groupBy("profile", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"), F.ceil(F.sum("used") / F.first("capacity")).alias("least_containers"), F.sum("items").alias("n_pieces"),
        F.sum("used").alias("n_tokens"), (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity"))).alias("fill"), F.max("used").alias("fullest"),
        (F.max("cost") / F.avg("cost")).alias("cost_max_over_mean"),
    )
