"""Full-text ranking: prefix terms with BM25 as full-text indexes rank, and plain Okapi BM25.

Texts are tokenised once per query in the JVM; corpus statistics are observed while matching rows are
written. For many queries, `postings` builds the inverted index with places, laid out by the first two
characters of terms, and `rank_postings` reads only the matching part of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hybridlake.functions.text import ACCENTED, BASE, index_tokens, word_tokens
from hybridlake.session import cut_lineage


def _scored(base: DataFrame, counts: list[Column], score: Callable[[list[Column], Column, dict], Column]) -> DataFrame:
    """(key, score) of rows in which any of the terms occurs.

    base: (key, _in, _d, _t...). The table is read and tokenised once: rows that match are written
    while the statistics of all rows (_n, _avg, _df<i>) are observed on the way.
    """
    names = [f"_tf{i}" for i in range(len(counts))]
    counted = base.select("key", "_in", "_d", *[c.cast("double").alias(n) for c, n in zip(counts, names, strict=True)])
    if not names:
        return counted.where(F.lit(False)).select("key", F.lit(0.0).alias("score"))
    seen = Observation()
    counted = counted.observe(seen, F.count(F.lit(1)).alias("_n"), F.avg("_d").alias("_avg"), *[F.count_if(F.col(n) > 0).alias(f"_df{i}") for i, n in enumerate(names)])
    hits = cut_lineage(counted.where((F.greatest(*names, F.lit(0.0)) > 0) & F.col("_in")))
    return hits.select("key", score([F.col(n) for n in names], F.col("_d"), seen.get).alias("score"))


def phrase(term: str) -> list[str]:
    """The index tokens of a query term: `foo_bar` is the phrase foo, bar."""
    return [t for t in re.split(r"[\W_]+", term.lower().translate(str.maketrans(ACCENTED, BASE))) if t]


def _occurrences(tokens: Column, words: list[str]) -> Column:
    """How often a phrase occurs in an array of tokens, its last word by prefix."""
    if len(words) == 1:
        return F.size(F.filter(tokens, lambda x: x.startswith(words[0])))
    places = F.when(F.size(tokens) >= len(words), F.sequence(F.lit(1), F.size(tokens) - (len(words) - 1))).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        same = F.get(tokens, i + len(words) - 2).startswith(words[-1])
        for j, w in enumerate(words[:-1]):
            same = same & (F.get(tokens, i + j - 1) == w)
        return same

    return F.size(F.filter(places, at))


def prefix_rank(df: DataFrame, key: Column, texts: list[Column], terms: list[str], where: Column | None = None) -> DataFrame:
    """(key, score) of rows that hold any of the terms; the score sums over terms
    idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean length)), with an idf of ln((N - df + 0.5) / (df + 0.5)),
    but at least 1e-6. A term of several tokens is a phrase within one column; its last token counts by prefix.
    Without terms there are no rows. Statistics are of the whole table, whatever `where` keeps."""
    words = [list(w) for w in dict.fromkeys(tuple(phrase(t)) for t in terms) if w]
    columns = [f"_t{i}" for i in range(len(texts))]
    base = df.select(key.alias("key"), (where if where is not None else F.lit(True)).alias("_in"), *[index_tokens(t).alias(c) for t, c in zip(texts, columns, strict=True)])
    base = base.withColumn("_d", sum((F.size(c) for c in columns), F.lit(0)))
    counts = [sum((_occurrences(F.col(c), w) for c in columns), F.lit(0)) for w in words]

    def score(tf: list[Column], length: Column, seen: dict) -> Column:
        total = F.lit(0.0)
        for i, t in enumerate(tf):
            n, df_ = seen["_n"], seen[f"_df{i}"]
            idf = max(math.log((n - df_ + 0.5) / (df_ + 0.5)), 1e-6)
            total = total + F.lit(idf) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * length / F.lit(seen["_avg"] or 1.0)))
        return total

    return _scored(base, counts, score)


def okapi(df: DataFrame, key: Column, text: Column, query: str, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score > 0): Okapi BM25 over words of more than two characters; a term repeated in the query counts again."""
    terms = [t for t in re.split(r"[^\w]+", query.lower()) if len(t) > 2]
    names = list(dict.fromkeys(terms))
    base = df.select(key.alias("key"), F.lit(True).alias("_in"), word_tokens(text, 2).alias("_t")).withColumn("_d", F.size("_t"))
    equal = lambda p: F.size(F.filter("_t", lambda x: x == p))
    counts = [equal(p) for p in names]

    def score(tf: list[Column], length: Column, seen: dict) -> Column:
        total = F.lit(0.0)
        for i, (name, t) in enumerate(zip(names, tf, strict=True)):
            n, df_ = seen["_n"], seen[f"_df{i}"]
            idf = math.log((n - df_ + 0.5) / (df_ + 0.5) + 1)
            total = total + F.lit(terms.count(name) * idf) * t * (k1 + 1) / (t + k1 * (1 - b + b * length / F.lit(seen["_avg"] or 1.0)))
        return total

    return _scored(base, counts, score).where("score > 0")


def postings(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """The inverted index (bucket, term, key, tf, places, length): each term's places in the text, from 1.

    Write it partitioned by bucket, the term's first two characters, so that a query reads its terms' buckets only.
    """
    tokens = df.select(key.alias("key"), index_tokens(text).alias("_t")).select("key", F.size("_t").alias("length"), F.posexplode("_t").alias("at", "term"))
    per = tokens.groupBy("term", "key").agg(F.array_sort(F.collect_list(F.col("at") + 1)).alias("places"), F.first("length").alias("length"))
    return per.select(F.substring("term", 1, 2).alias("bucket"), "term", "key", F.size("places").cast("long").alias("tf"), "places", "length")


def rank_postings(index: DataFrame, terms: list[str], n_rows: int, mean_length: float) -> DataFrame:
    """(key, score) as prefix_rank has it for one column, from the postings: only buckets of the terms are read."""
    phrases = [w for w in dict.fromkeys(tuple(phrase(t)) for t in terms) if w]
    if not phrases:
        return index.where(F.lit(False)).select("key", F.lit(0.0).alias("score"))

    def held(word: str, last: bool) -> Column:
        in_bucket = F.col("bucket").startswith(word) if last and len(word) < 2 else F.col("bucket") == word[:2]
        return in_bucket & (F.col("term").startswith(word) if last else F.col("term") == word)

    named = [(i, j, held(w, j == len(p) - 1)) for i, p in enumerate(phrases) for j, w in enumerate(p)]
    roles = F.filter(F.array(*[F.when(h, F.struct(F.lit(i).alias("phrase"), F.lit(j).alias("word"))) for i, j, h in named]), lambda x: x.isNotNull())
    hit = reduce(lambda a, c: a | c, [h for _, _, h in named])
    # A phrase stands where each of its words has the place that leads to the same start.
    starts = index.where(hit).select("key", "length", "places", F.explode(roles).alias("r")).select("key", "length", "r.phrase", "r.word", F.explode("places").alias("at"))
    sizes = F.array(*[F.lit(len(p)) for p in phrases])
    whole = starts.groupBy("phrase", "key", (F.col("at") - F.col("word")).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.first("length").alias("length")).where(F.col("n") == F.get(sizes, F.col("phrase")))
    per = cut_lineage(whole.groupBy("phrase", "key").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.first("length").alias("length")))
    df_ = per.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    t = F.col("tf")
    part = F.greatest(F.ln((F.lit(n_rows) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * F.col("length") / F.lit(mean_length)))
    # One row per query term.
    return per.join(F.broadcast(df_), "phrase").groupBy("key").agg(F.sum(part).alias("score"))


def top(ranked: DataFrame, k: int, *, score: str = "score", key: str = "key") -> DataFrame:
    """The k best rows; equal scores by key."""
    return ranked.orderBy(F.col(score).desc(), F.col(key)).limit(k)
