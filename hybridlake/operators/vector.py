"""Exact nearest neighbours.

One query vector: a scan with a distance expression and a top-k. A set of query vectors: both sides
are packed into blocks of rows, every block pair is one matrix product in a Python worker, and each
gives the k best of its rows, which are merged per query. Blocks bound the memory of a task, and
the pairs of rows are never rows themselves.

Defined results: null ids, null vectors and vectors of another length than the query's are left
out; equal distances are ordered by id; a zero vector has cosine distance 1; k below the number of
rows returns them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def _as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_as_double(a), _as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(_as_double(x), _as_double(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / size)


def embed(df: DataFrame, key: Column, text: Column, model: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(key, vector): each text's vector from the model, scaled to length 1; the model gets batches of texts.

    Null texts are embedded as empty ones; texts of a zero vector are left out.
    """
    picked = df.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.asarray(model(pdf["text"].tolist()), np.float64).reshape(len(pdf), -1)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            some = size[:, 0] > 0
            yield pd.DataFrame({"key": pdf["key"][some], "vector": list(v[some] / size[some])})

    return picked.mapInPandas(run, f"key {kind}, vector array<double>")


def put_vectors(old: DataFrame, new: DataFrame, base: DataFrame) -> DataFrame:
    """The vector table (key, vector) after an upsert: new vectors replace old ones, and only keys of `base` (key) are kept."""
    fresh = new.dropDuplicates(["key"]).join(base.select("key").distinct(), "key", "left_semi")
    return old.select("key", "vector").join(fresh.select("key"), "key", "left_anti").unionByName(fresh.select("key", "vector"))


def nearest(df: DataFrame, key: Column, vector: Column, query: list[float], k: int, digits: int | None = None) -> DataFrame:
    """(key, distance) of the k rows nearest to one query vector by Euclidean distance, rounded if digits are given."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = df.select(key.alias("key"), vector.alias("_v")).where(F.col("key").isNotNull() & (F.size("_v") == len(query)))
    distance = l2(F.col("_v"), q)
    return rows.select("key", (distance if digits is None else F.round(distance, digits)).alias("distance")).orderBy("distance", "key").limit(k)


def _blocks(df: DataFrame, id_: Column, vector: Column, name: str) -> DataFrame:
    """Rows packed into (ids, matrix) blocks of at most BLOCK rows within each partition."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, same in pdf.groupby(pdf["v"].str.len()):
                for s in range(0, len(same), BLOCK):
                    part = same.iloc[s : s + BLOCK]
                    yield pd.DataFrame({f"{name}_ids": [part["id"].tolist()], f"{name}_dim": [int(size)], f"{name}_matrix": [np.stack(part["v"]).astype(np.float64).tobytes()]})

    rows = df.select(id_.cast("long").alias("id"), vector.cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.mapInPandas(pack, f"{name}_ids array<long>, {name}_dim int, {name}_matrix binary")


def nearest_to_each(queries: DataFrame, rows: DataFrame, *, query_id: Column, row_id: Column, query_vector: Column, row_vector: Column, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, row_id, distance, rank from 1): for each query the k nearest other rows."""
    q = _blocks(queries, query_id, query_vector, "q")
    r = _blocks(rows, row_id, row_vector, "r")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, b in pdf.iterrows():
                qi, ri = np.asarray(b["q_ids"], np.int64), np.asarray(b["r_ids"], np.int64)
                qm = np.frombuffer(b["q_matrix"]).reshape(len(qi), -1)
                rm = np.frombuffer(b["r_matrix"]).reshape(len(ri), -1)
                if metric == "cosine":
                    sizes = np.linalg.norm(qm, axis=1)[:, None] * np.linalg.norm(rm, axis=1)[None, :]
                    dist = np.where(sizes > 0, 1 - qm @ rm.T / np.where(sizes > 0, sizes, 1), 1.0)
                else:
                    square = (qm**2).sum(1)[:, None] + (rm**2).sum(1)[None, :] - 2 * qm @ rm.T
                    dist = np.sqrt(np.maximum(square, 0))
                    # Differences taken anew where cancellation would show.
                    close = np.argwhere(square < 1e-6)
                    for i, j in close:
                        dist[i, j] = np.sqrt(((qm[i] - rm[j]) ** 2).sum())
                dist[qi[:, None] == ri[None, :]] = np.inf
                order = np.lexsort((np.broadcast_to(ri, dist.shape), dist), axis=1)[:, :k]
                for i in range(len(qi)):
                    d = dist[i, order[i]]
                    keep = np.isfinite(d)
                    yield pd.DataFrame({"query_id": qi[i], "row_id": ri[order[i]][keep], "distance": d[keep]})

    # Blocks, not rows, are paired.
    pairs = q.crossJoin(r).where("q_dim = r_dim")
    found = pairs.mapInPandas(best, "query_id long, row_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "row_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
