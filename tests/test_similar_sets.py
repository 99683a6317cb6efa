import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hybridlake.operators import analytics as A
from hybridlake.operators import similar_sets as S


def corpus(n):
    r = random.Random(5)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = r.choice(rows)[1].split()
            if r.random() < 0.6:
                w[r.randrange(len(w))] = f"v{r.randrange(30)}"
        else:
            w = [f"w{r.randrange(30)}" for _ in range(r.choice([1, 4, 9, 9, 9, 30, 200]))]
        rows.append((i, " ".join(w), r.choice([None, 0.1, 0.5, 0.5, 0.9, float("nan")])))
    return rows


def brute(rows, t):
    sets = {k: {x[i : i + 3] for i in range(max(1, len(x) - 2))} for k, x, _ in rows}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def test_pairs_and_losers_against_brute_force(spark):
    rows = corpus(220)
    score = {k: s for k, _, s in rows}
    df = spark.createDataFrame([*rows, (None, "w1 w2 w3", 0.1), (500, None, 0.1)], "id long, t string, s double").withColumn("g", A.ngrams(F.col("t")))
    want = brute(rows, 0.7)
    rank = lambda s: float("inf") if s != s else s
    lost = {b if None not in (score[a], score[b]) and rank(score[a]) >= rank(score[b]) else a for a, b in want}
    for block in (None, 150, 2000):
        s = S.similar(df, "id", "g", 0.7, block)
        assert {(r.key_a, r.key_b): r.similarity for r in S.pairs_of_keys(s).collect()} == want
        assert {r.id for r in S.losers(s, df, "id", F.col("s")).collect()} == lost


def test_blocks_hold_so_many_elements_and_meet_by_size():
    of, meetings, tasks = S._blocks([(10, 100), (11, 5), (50, 1000)], 0.7, 2000)
    assert of == [(10, 0, 1), (11, 0, 1), (50, 1, 25)] and tasks == 1 + 25 * 26 // 2
    assert all(i == 0 for i, k, _ in meetings if k == 0) and S._blocks([], 0.7, None) == ([], [], 0)


def test_copies_are_one_class_for_losers(spark):
    # So many copies would be 12.5 million pairs of keys.
    df = spark.range(5000).select("id", F.array(F.lit("abc"), F.lit("bcd")).alias("g"), F.lit(0.5).alias("s"))
    s = S.similar(df, "id", "g", 0.7)
    assert s.pairs.count() == 0 and S.losers(s, df, "id", F.col("s")).count() == 4999


def test_sets_of_common_elements_take_little_memory():
    # Each element is in a sixth of 4,000 sets, so prefixes leave millions of candidates.
    r = np.random.default_rng(1)
    has = r.random((4000, 60)) < 1 / 6
    has[2000:] = has[:2000] ^ (r.random((2000, 60)) < 0.02)
    has[:, 0] = True
    xs = [np.flatnonzero(x).tolist() for x in has]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4000, pa.int32()), pa.array(range(4000), pa.int64()), pa.array([False] * 4000), pa.array(xs, pa.list_(pa.int64()))], ["side", "c", "more", "xs"])
    tracemalloc.start()
    got = {(min(p), max(p)) for b in S._compared(0.7)(iter([batch])) for p in zip(b.column("c_a").to_pylist(), b.column("c_b").to_pylist(), strict=True)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    m, n = has.astype(np.float32) @ has.T.astype(np.float32), has.sum(axis=1)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(m / (n[:, None] + n - m) >= np.float32(0.7), 1))), strict=True)) and peak < 40e6
