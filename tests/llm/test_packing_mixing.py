import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hybridlake.llm import mixing, packing
from hybridlake.llm.tokens import DEFAULT_RANKS, count_tokens, encoding


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 90))
def test_assign_keeps_capacity(sizes, capacity):
    tokens = np.array(sorted(sizes, reverse=True), np.int64)
    where = packing.assign(tokens, capacity)
    used = {}
    for w, n in zip(where, tokens, strict=True):
        used[w] = used.get(w, 0) + n
    assert all(v <= capacity for v in used.values())
    # Any two containers can't be merged into one: at most twice the least number.
    assert len(used) <= 2 * max(1, -(-int(tokens.sum()) // capacity))


def test_pack_places_everything_once(spark):
    r = random.Random(3)
    docs = [(i, r.choice([0, 1, 5, 40, 99, 100, 101, 730])) for i in range(300)] + [(7, 12), (None, 30), (900, None)]
    df = spark.createDataFrame(docs, "item_id long, n_tokens int")
    profiles = spark.createDataFrame([("s", 100), ("l", 1000)], "profile string, capacity int")
    got = packing.pack(df, profiles, per_shard=64).collect()
    for profile, capacity in (("s", 100), ("l", 1000)):
        mine = [x for x in got if x.profile == profile]
        assert sum(x.n_tokens for x in mine) == sum(n or 0 for _, n in docs)
        used = {}
        for x in mine:
            used[x.shard, x.container] = used.get((x.shard, x.container), 0) + x.n_tokens
            assert x.n_tokens == capacity or x.piece_no == max(y.piece_no for y in mine if y.item_id == x.item_id and y.token_start >= x.token_start)
        assert max(used.values()) <= capacity
        assert all(x.piece_no == 0 for x in mine if x.item_id not in (7, None) and dict(docs)[x.item_id] <= capacity)
    fill = {x.profile: x.fill for x in packing.report(packing.pack(df, profiles)).collect()}
    assert fill["l"] > 0.9
    assert packing.pack(df.limit(0), profiles).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, spark.createDataFrame([("x", 0)], "profile string, capacity int"))


def test_poisson_inverse_is_the_distribution():
    u = (np.arange(100_000) + 0.5) / 100_000
    got = mixing.poisson_inverse(u, 1.3, 20)
    assert abs(got.mean() - 1.3) < 1e-3 and abs(got.var() - 1.3) < 5e-3
    assert mixing.poisson_inverse(u, 0.0, 3).max() == 0 and mixing.poisson_inverse(u, np.inf, 3).min() == 3
    more = mixing.poisson_inverse(u, 2.0, 4)
    assert (more >= mixing.poisson_inverse(u, 1.9, 4)).all() and more.max() == 4


def test_mix_reaches_shares(spark):
    r = random.Random(5)
    docs = [(i, r.choice(["Big Source", " big_source", "BIG-SOURCE"]) if i % 3 else "small", r.randint(50, 200)) for i in range(3000)]
    docs += [(10_001, None, 5), (10_002, "other", 5), (10_003, "small", 0), (10_004, "small", None), (1, "big source", 3), (None, "small", 60)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("big_source", 0.2, 1), ("small", 0.6, 2), ("missing", 0.2, 5), ("none", None, 1), ("bad", -1.0, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(df, targets)
    rows, shares = mixture.collect(), {x.source: x for x in report.collect()}
    assert set(shares) == {"big_source", "small", "missing"} and shares["missing"].actual_share == 0
    assert abs(shares["big_source"].actual_share - 0.25) < 0.01 and abs(shares["small"].actual_share - 0.75) < 0.01
    assert shares["small"].max_copies == 2 and shares["big_source"].max_copies == 1
    assert len({(x.doc_id, x.copy_no) for x in rows}) == len(rows) and [x.shuffle_key for x in rows] == sorted(x.shuffle_key for x in rows)
    again, _ = mixing.mix(df, targets)
    assert again.collect() == rows
    empty, report = mixing.mix(df.limit(0), targets)
    assert empty.count() == 0 and {x.actual_share for x in report.collect()} == {0}
    assert mixing.mix(df, targets.limit(0))[0].count() == 0


def test_token_counts():
    assert count_tokens(None) == count_tokens("") == 0 and count_tokens("hello world") == 2
    whole = lambda x: len(encoding(DEFAULT_RANKS).encode_ordinary(x))
    r = random.Random(1)
    for _ in range(20):
        text = "".join(r.choice(["the cat", "it's", " ", "  ", "\n\n", "\t", " 12,5", "x" * 50, "été\u00a0", "。", "!!"]) for _ in range(30_000))
        assert len(text) > 60_000 and count_tokens(text) == whole(text)
    assert count_tokens("x" * 100_000) == whole("x" * 100_000)
    for blanks in (3_000, 5_001):
        for text in (" " * blanks, "a" + " " * blanks + "b", "\n" * blanks + "b", "a" + " \n" * blanks):
            assert count_tokens(text) == whole(text), repr(text[:5])
    assert count_tokens("a" + " " * 2_000_000 + "b") > 1


def test_shards_follow_the_pieces(spark):
    df = spark.createDataFrame([(i, 1000) for i in range(100)], "item_id long, n_tokens int")
    got = packing.pack(df, spark.createDataFrame([("s", 10), ("l", 1000)], "profile string, capacity int"), per_shard=100)
    assert {r.profile: r.n for r in got.groupBy("profile").agg(F.countDistinct("shard").alias("n")).collect()} == {"s": 100, "l": 1}
