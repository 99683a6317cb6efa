"""Stand-alone analytics: scores, trends, similarity of short texts, scans by patterns, text statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridlake.operators import similar_sets


def log1p_safe(x: Column) -> Column:
    """ln(1 + x), 0 for null and negative values."""
    return F.when(x >= 0, F.log1p(x)).otherwise(0.0)


def forum_engagement(score: Column, comments: Column, ratio: Column) -> Column:
    """Weighted logarithms; null if neither score nor comments are known; an unknown or zero ratio is 0.5."""
    ratio = F.when(ratio.isNull() | (ratio == 0), 0.5).otherwise(ratio)
    return F.when(score.isNotNull() | comments.isNotNull(), 0.55 * log1p_safe(score) + 0.40 * log1p_safe(comments) + 0.05 * ratio * 10)


def post_engagement(likes: Column, reposts: Column, replies: Column, quotes: Column) -> Column:
    return F.when(likes.isNotNull() | reposts.isNotNull(), 0.55 * log1p_safe(likes) + 0.25 * log1p_safe(reposts) + 0.15 * log1p_safe(replies) + 0.05 * log1p_safe(quotes))


def overall_score(relevance: Column, recency: Column, engagement: Column, raw: Column, confidence: Column, weights: tuple[float, float, float] = (0.45, 0.25, 0.30), unknown: int = 35, penalty: int = 10) -> Column:
    """Weighted sum of sub-scores less penalties, cut to whole numbers from 0 to 100."""
    parts = F.lit(weights[0]) * (relevance * 100).cast("int") + F.lit(weights[1]) * recency + F.lit(weights[2]) * F.coalesce(engagement.cast("int"), F.lit(unknown))
    less = F.when(raw.isNull(), penalty).otherwise(0) + F.when(confidence == "low", 10).when(confidence == "med", 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), (parts - less).cast("int")))


def recency_score(day: Column, today: Column, max_days: int = 30) -> Column:
    """100 for today and the future, falling to 0 after max_days; 0 for null; whole numbers."""
    age = F.datediff(today, day)
    return F.when(day.isNull(), 0).when(age < 0, 100).when(age >= max_days, 0).otherwise((100 * (1 - age / max_days)).cast("int"))


def date_confidence(text: Column, low: str, high: str) -> Column:
    """high if a valid date lies in the range, else low."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(day.between(F.lit(low).cast("date"), F.lit(high).cast("date")), "high").otherwise("low")


def min_max(df: DataFrame, value: str, out: str, default: float = 50.0) -> DataFrame:
    """value scaled to 0..100 over the table; without a range every row gets the default, else nulls stay null."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    flat = F.col("_lo").isNull() | (span == 0)
    return df.join(F.broadcast(bounds), F.lit(True)).withColumn(out, F.when(flat, default).otherwise((F.col(value) - F.col("_lo")) / span * 100)).drop("_lo", "_hi")


def normal_text(text: Column) -> Column:
    """Lower case, signs as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters; a shorter text is its own only one."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) < n, F.array(text)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def similar_pairs(df: DataFrame, key: str, grams: str, threshold: float) -> DataFrame:
    """(key_a < key_b, similarity) of sets with Jaccard similarity of at least the threshold."""
    return similar_sets.pairs_of_keys(similar_sets.similar(df, key, grams, threshold))


def marked_duplicates(df: DataFrame, key: str, grams: str, score: str, threshold: float) -> DataFrame:
    """Keys that lose a pair: of every similar pair the lower score goes, of equal ones the greater key; marks don't spread."""
    return similar_sets.losers(similar_sets.similar(df, key, grams, threshold), df, key, F.col(score))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by the Abramowitz-Stegun polynomial 26.2.17 (error below 7.5e-8)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def two_proportions(df: DataFrame, hits_a: str, n_a: str, hits_b: str, n_b: str, alpha: float = 0.05) -> DataFrame:
    """df with rates, z, p_value (two-sided, pooled) and decision."""
    p1, p2 = F.col(hits_a) / F.col(n_a), F.col(hits_b) / F.col(n_b)
    pooled = (F.col(hits_a) + F.col(hits_b)) / (F.col(n_a) + F.col(n_b))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col(n_a) + 1 / F.col(n_b)))
    z = F.when(error > 0, (p2 - p1) / error).otherwise(0.0)
    out = df.withColumns({"rate_a": p1, "rate_b": p2, "z": z}).withColumn("p_value", 2 * (1 - normal_cdf(F.abs("z"))))
    return out.withColumn("decision", F.when(F.col("p_value") >= alpha, "undecided").when(F.col("z") > 0, "b").otherwise("a"))


def growth(df: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """First and last value of each group with at least two points, their difference and its percentage."""
    g = df.groupBy(group).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    change = F.col("last") - F.col("first")
    return g.withColumns({"change": change, "pct": F.when(F.col("first") != 0, change / F.col("first") * 100)})


def pattern_scan(df: DataFrame, key: Column, text: Column, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """(key, line_no, pattern, severity, snippet): every line that matches, once per pattern.

    patterns: (name, severity, regular expression). Matches are masked in the snippet but for three characters.
    """
    lines = df.select(key.alias("key"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    rules = F.array(*[F.when(F.col("line").rlike(rx), F.struct(F.lit(name).alias("pattern"), F.lit(sev).alias("severity"), F.regexp_replace(F.col("line"), rf"({rx})", "***").alias("masked"))) for name, sev, rx in patterns])
    hits = lines.select("key", (F.col("i") + 1).alias("line_no"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    return hits.select("key", "line_no", "r.pattern", "r.severity", F.substring("r.masked", 1, 80).alias("snippet"))


def severity_score(findings: DataFrame, key: str, weights: dict[str, int]) -> DataFrame:
    """100 less the weights of the findings' severities, at least 0."""
    cost = F.coalesce(F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col("severity")], F.lit(0))
    return findings.groupBy(key).agg(F.greatest(F.lit(0), F.lit(100) - F.sum(cost)).alias("score"))


def lexicon_sentiment(words: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative) / (positive + negative), 0 without either."""
    p = F.size(F.filter(words, lambda w: w.isin(positive)))
    n = F.size(F.filter(words, lambda w: w.isin(negative)))
    return F.when(p + n == 0, 0.0).otherwise((p - n) / (p + n))


def domain_of(text: Column, domains: dict[str, list[str]], otherwise: str) -> Column:
    """The domain of most keywords contained in the text; of equal ones the first; `otherwise` without any."""
    low = F.lower(text)
    counts = [sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for words in domains.values()]
    best = F.greatest(*counts, F.lit(0))
    out = F.when(best == 0, F.lit(otherwise))
    for name, c in zip(domains, counts, strict=True):
        out = out.when(c == best, name)
    return F.coalesce(out, F.lit(otherwise))
