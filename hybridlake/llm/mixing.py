"""Mixing of sources to target weights by Poisson replication.

Each record draws a uniform number from a hash of seed and id; its number of copies is the inverse
of the Poisson distribution at that number, capped at the source's largest number of repeats. All
records of a source share the Poisson mean, and copies grow with it, so the mean is calibrated in two
passes: a histogram of tokens over the uniform numbers brackets it, then a grid of means within the
bracket is summed exactly and the one nearest to the source's target tokens is taken. Copies are then shuffled globally by another hash.

The total is the largest at which every source that has records can reach its share:
min(repeats * tokens / share). Shares are relative to the sources that have both a target and
records; the report names the others, with an actual share of 0.

Defined results: source names compare in lower case, without blanks around them, blanks and
hyphens inside as underscores, so all spellings are one source; records without tokens (null or
empty text), without a source, or of a source without a target are not used; of repeated ids the
row with most tokens counts; targets that are null, not positive, or with no repeats are taken as
no target; of a repeated target the shares add up and the least number of repeats holds; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridlake.session import cut_lineage

#: The target table is a parameter, not data.
MOST_SOURCES = 10_000
#: Steps of the uniform number in the histogram of tokens, over all sources together at most, and means tried exactly.
MOST_STEPS, ALL_STEPS, GRID = 4096, 1 << 20, 129


def source_name(source: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s\-]+", "_"), F.lit(""))


def poisson_inverse(u: np.ndarray, mean: float, most: int) -> np.ndarray:
    """min(most, least c with u < P(X <= c)); all `most` if the mean is infinite."""
    out = np.zeros(len(u), np.int64)
    if not np.isfinite(mean):
        return out + most
    # Terms in logarithms, so that a large mean doesn't underflow.
    c = np.arange(most)
    log_terms = -mean + c * np.log(max(mean, 1e-300)) - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most)))])[:most]
    cdf = np.cumsum(np.exp(log_terms)) if mean > 0 else np.ones(most)
    return np.searchsorted(np.minimum(cdf, 1.0), u, side="right").clip(0, most)


def _uniform(seed: int, *columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) * F.lit(2.0**-53)


def targets(table: DataFrame) -> dict[str, tuple[float, int]]:
    """Source -> (share, most repeats)."""
    rows = table.select(source_name(F.col("source")).alias("s"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("m"))
    rows = rows.where("s is not null and w > 0 and m > 0").groupBy("s").agg(F.sum("w"), F.min("m")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    return {s: (float(w), int(m)) for s, w, m in rows}


def _drawn(base: DataFrame, means: dict[str, np.ndarray], repeats: dict[str, int]) -> dict[str, np.ndarray]:
    """Per source, the tokens drawn under each of its means; summed in each task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, int], int] = {}
        for pdf in batches:
            for s, part in pdf.groupby("source"):
                n, u = part["n_tokens"].to_numpy(np.int64), part["u"].to_numpy()
                for g, mean in enumerate(means[s]):
                    total[s, g] = total.get((s, g), 0) + int((n * poisson_inverse(u, mean, repeats[s])).sum())
        yield pd.DataFrame([(s, g, t) for (s, g), t in total.items()], columns=["source", "g", "tokens"])

    out = {s: np.zeros(len(m), np.int64) for s, m in means.items()}
    for s, g, t in base.select("source", "n_tokens", "u").mapInPandas(run, "source string, g int, tokens long").groupBy("source", "g").agg(F.sum("tokens")).collect():
        out[s][g] = t
    return out


def _bracket(weights: np.ndarray, goal: float, most: int) -> tuple[float, float]:
    """Means between which the tokens drawn pass the goal, from tokens by equal steps of the uniform number."""
    edges = np.arange(len(weights) + 1) / len(weights)

    def first(u: np.ndarray) -> float:
        """The mean at which tokens drawn reach the goal if each step's records all stood at its u."""
        # A capped Poisson of the largest mean falls short of the cap by less than one in a billion.
        lo, hi = 0.0, 4.0 * most + 60.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if (weights * poisson_inverse(u, mid, most)).sum() >= goal else (mid, hi)
        return hi

    # Copies grow with u: upper edges overstate what is drawn, lower edges understate it.
    return max(0.0, first(edges[1:] - 1e-12) * (1 - 1e-9)), first(edges[:-1])


def mix(docs: DataFrame, target_table: DataFrame, *, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, source, n_tokens).

    Returns the mixture (shuffle_key, doc_id, copy_no from 1, source, n_tokens), in shuffled order,
    and the report (source, target_share, reachable_share, actual_share, source_tokens,
    drawn_tokens, n_docs, n_copies, max_copies), one row per source with a target.
    """
    spark = docs.sparkSession
    want = targets(target_table)
    named = docs.select("doc_id", source_name(F.col("source")).alias("source"), "n_tokens").where((F.col("n_tokens") > 0) & F.col("source").isin(list(want)))
    once = named.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("m")).select("doc_id", "m.source", "m.n_tokens")
    base = cut_lineage(once.withColumn("u", _uniform(seed, "doc_id")))
    have = {s: int(t) for s, t in base.groupBy("source").agg(F.sum("n_tokens")).collect()}

    scale = sum(want[s][0] for s in have)
    share = {s: want[s][0] / scale for s in have}
    repeats = {s: want[s][1] for s in have}
    total = min((repeats[s] * have[s] / share[s] for s in have), default=0.0)
    goal = {s: total * share[s] for s in have}

    best = {s: (abs(repeats[s] * have[s] - goal[s]), np.inf) for s in have}
    steps = max(64, min(MOST_STEPS, ALL_STEPS // max(1, len(have))))
    weights = {s: np.zeros(steps, np.int64) for s in have}
    if have:
        for s, at, n in base.groupBy("source", F.floor(F.col("u") * steps).cast("int").alias("at")).agg(F.sum("n_tokens")).collect():
            weights[s][at] = n
        grid = {s: np.linspace(*_bracket(weights[s], goal[s], repeats[s]), GRID) for s in have}
        for s, got in _drawn(base, grid, repeats).items():
            at = int(np.abs(got - goal[s]).argmin())
            best[s] = min(best[s], (abs(int(got[at]) - goal[s]), float(grid[s][at])))
    mean = {s: best[s][1] for s in have}

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            copies = np.zeros(len(pdf), np.int32)
            for s in pdf["source"].unique():
                its = (pdf["source"] == s).to_numpy()
                copies[its] = poisson_inverse(pdf["u"].to_numpy()[its], mean[s], repeats[s])
            yield pdf.assign(copies=copies)[["doc_id", "source", "n_tokens", "copies"]]

    id_type = docs.schema["doc_id"].dataType.simpleString()
    drawn = base.mapInPandas(draw, f"doc_id {id_type}, source string, n_tokens int, copies int")
    mixture = drawn.where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "source", "n_tokens")
    mixture = mixture.select(F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no").alias("shuffle_key"), "doc_id", "copy_no", "source", "n_tokens").orderBy("shuffle_key", "doc_id", "copy_no")

    goals = spark.createDataFrame([(s, w, share.get(s, 0.0)) for s, (w, _) in sorted(want.items())], "source string, target_share double, reachable_share double")
    each = drawn.groupBy("source").agg(
        F.sum("n_tokens").alias("source_tokens"), F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("drawn_tokens"),
        F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("max_copies"),
    )
    all_ = each.agg(F.sum("drawn_tokens")).first()[0] or 1
    report = goals.join(F.broadcast(each), "source", "left").na.fill(0).withColumn("actual_share", F.col("drawn_tokens") / F.lit(float(all_)))
    return mixture, report.select("source", "target_share", "reachable_share", "actual_share", "source_tokens", "drawn_tokens", "n_docs", "n_copies", "max_copies")
