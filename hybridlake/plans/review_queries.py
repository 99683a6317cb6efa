"""Reports on observations read as reviews, and on code: sentiment, issues, shared names, complexity, weighted scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridlake.functions import text as T
from hybridlake.plans.analytics_queries import _BAD, _GOOD, _WORDS
from hybridlake.plans.registry import Registry
from hybridlake.plans.search_queries import latest_nodes
from hybridlake.sources.tables import table

R = Registry()

_RATED = "r AS (SELECT id, unnest(min({'a': ingested_at, 'content': content, 'rating': confidence * 5})) FROM observations GROUP BY id)"
_COUNTS = f"c AS (SELECT id, rating, len(list_filter(w, lambda x: list_contains({_GOOD!r}, x))) AS p, len(list_filter(w, lambda x: list_contains({_BAD!r}, x))) AS n FROM (SELECT id, rating, {_WORDS.format('content', 0)} AS w FROM r))"
_SCORE = "s AS (SELECT id, greatest(-1, least(1, 0.6e0 * (rating - 3) / 2 + 0.4e0 * (p - n) / 10)) AS s FROM c WHERE rating IS NOT NULL)"


def _rated(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").withColumn("rating", F.col("confidence") * 5)
    return o.groupBy("id").agg(F.min(F.struct("ingested_at", "content", "rating")).alias("m")).select("id", "m.content", "m.rating")


@R.add(
    "review_sentiment",
    f"WITH {_RATED}, {_COUNTS}, {_SCORE}, l AS (SELECT CASE WHEN s > 0.3 THEN 'positive' WHEN s < -0.3 THEN 'negative' ELSE 'neutral' END AS label FROM s) SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM l), 4)::DOUBLE AS pct FROM l GROUP BY label",
)
def review_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Rating and word lists in one score from -1 to 1; how the labels are distributed."""
    words = T.word_tokens(F.col("content"))
    hits = lambda xs: F.size(F.filter(words, lambda w: w.isin(xs)))
    s = 0.6 * (F.col("rating") - 3) / 2 + 0.4 * (hits(_GOOD) - hits(_BAD)) / 10
    one = _rated(spark, d).where("rating is not null").select(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)).alias("s"))
    label = F.when(F.col("s") > 0.3, "positive").when(F.col("s") < -0.3, "negative").otherwise("neutral")
    g = one.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # Three labels at most.
    return g.join(F.broadcast(g.agg(F.sum("n").alias("_all"))), F.lit(True)).select("label", "n", F.round(F.col("n") * 100 / F.col("_all"), 4).alias("pct"))


_ISSUES = ["error", "slow", "trouble", "drift", "broken"]


@R.add(
    "issue_report",
    f"WITH {_RATED}, h AS (SELECT unnest(list_filter({_ISSUES!r}, lambda w: contains(lower(content), w))) AS issue FROM r WHERE rating <= 4) SELECT issue, count(*) AS n FROM h GROUP BY issue ORDER BY n DESC, issue LIMIT 15",
)
def issue_report(spark: SparkSession, d: str) -> DataFrame:
    """Low ratings that name an issue; the most frequent issues."""
    hit = F.filter(F.array(*[F.lit(w) for w in _ISSUES]), lambda w: F.contains(F.lower("content"), w))
    g = _rated(spark, d).where("rating <= 4").select(F.explode(hit).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "issue").limit(15)


_NODES = "one AS (SELECT id, unnest(max({'a': ingested_at, 'name': name, 'module': module, 'type': type, 'raw_body': raw_body})) FROM nodes GROUP BY id)"


@R.add("shared_names", f"WITH {_NODES} SELECT name, count(DISTINCT module) AS modules, count(*) AS n, greatest(0, 100 - 3 * count(DISTINCT module))::BIGINT AS score FROM one WHERE type IN ('function', 'class') GROUP BY name HAVING count(DISTINCT module) > 1")
def shared_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of functions and classes that several modules define."""
    n = latest_nodes(spark, d, ["name", "module", "type"]).where("type in ('function', 'class')")
    g = n.groupBy("name").agg(F.countDistinct("module").alias("modules"), F.count(F.lit(1)).alias("n")).where("modules > 1")
    return g.select("name", "modules", "n", F.greatest(F.lit(0), 100 - 3 * F.col("modules")).alias("score"))


# What opens a further path through code.
_BRANCHES = [r"\bif\b", r"\belif\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bexcept\b", r"\bcatch\b", r"&&", r"\|\|"]


@R.add("complexity", f"WITH {_NODES} SELECT id, (1 + " + " + ".join(f"len(regexp_extract_all(raw_body, '{b}'))" for b in _BRANCHES) + ")::INTEGER AS cyclomatic FROM one WHERE type IN ('function', 'method') AND raw_body IS NOT NULL")
def complexity(spark: SparkSession, d: str) -> DataFrame:
    """Cyclomatic complexity by counting branches."""
    n = latest_nodes(spark, d, ["type", "raw_body"]).where("type in ('function', 'method') and raw_body is not null")
    return n.select("id", sum((F.regexp_count("raw_body", F.lit(b)) for b in _BRANCHES), F.lit(1)).cast("int").alias("cyclomatic"))


_WEIGHTS = {"click": 0.2, "purchase": 0.5, "view": 0.3}


@R.add("weighted_score", "SELECT user_id, round(sum(m * w), 6) AS score FROM (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) JOIN (VALUES " + ", ".join(f"('{k}', {v}e0)" for k, v in _WEIGHTS.items()) + ") AS t(event_type, w) USING (event_type) GROUP BY user_id")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean values of event types by weight; missing types count as nothing."""
    e = table(spark, d, "events").where(F.col("event_type").isin(list(_WEIGHTS))).groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    w = F.create_map(*[F.lit(x) for p in _WEIGHTS.items() for x in p])[F.col("event_type")]
    return e.groupBy("user_id").agg(F.round(F.sum(F.col("m") * w), 6).alias("score"))
