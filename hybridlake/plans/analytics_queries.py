"""Analytics over events, orders, line items, observations, memories and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridlake.functions import text as T
from hybridlake.operators import analytics as A
from hybridlake.plans.registry import Registry
from hybridlake.plans.store_queries import _OBS, observations_of
from hybridlake.sources.tables import table

R = Registry()

# Stop words of the reports.
STOP = ["the", "and", "that", "with", "this", "from", "have", "for", "not", "was", "are", "but", "has", "had", "its", "our", "you", "who", "will", "been", "were"]
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: len(w) > {1})"
_STOP = ", ".join(f"'{w}'" for w in STOP)


@R.add(
    "best_times",
    "SELECT hour(ts) AS hour, dayofweek(ts) AS weekday, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(max(value), 6) AS top FROM events GROUP BY ALL HAVING count(*) >= 2",
)
def best_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    g = e.groupBy(F.hour("ts").cast("bigint").alias("hour"), (F.dayofweek("ts") - 1).cast("bigint").alias("weekday"))
    return g.agg(F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("top"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


@R.add(
    "top_items_pivot",
    "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id",
)
def top_items_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "purchase", "view")])


@R.add(
    "growth_trend",
    """WITH m AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL),
    g AS (SELECT o_custkey, arg_min(v, month) AS first, arg_max(v, month) AS last, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 2)
    SELECT o_custkey, first, last, n, round(last - first, 4) AS change, round((last - first) / first * 100, 4) AS pct FROM g""",
)
def growth_trend(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return A.growth(m, "o_custkey", "month", "v").withColumns({"change": F.round("change", 4), "pct": F.round("pct", 4)})


@R.add(
    "status_rollup",
    "SELECT o_orderpriority, strftime(o_orderdate, '%Y') AS year, sum((o_orderstatus = 'F')::BIGINT)::BIGINT AS done, sum((o_orderstatus = 'O')::BIGINT)::BIGINT AS open, round(max(o_totalprice), 2) AS largest FROM orders GROUP BY ALL",
)
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy").alias("year"))
    return g.agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.round(F.max("o_totalprice"), 2).alias("largest"))


@R.add("minmax_norm", "SELECT event_id, round(coalesce((value - lo) / nullif(hi - lo, 0) * 100, 50), 6) AS scaled FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    return A.min_max(table(spark, d, "events"), "value", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


@R.add(
    "themes",
    f"WITH {_OBS}, w AS (SELECT type, unnest({_WORDS.format('content', 3)}) AS word FROM ob), c AS (SELECT type, word, count(*) AS n FROM w WHERE word NOT IN ({_STOP}) GROUP BY ALL HAVING count(*) >= 3) SELECT type, word, n FROM c QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC, word) <= 10",
)
def themes(spark: SparkSession, d: str) -> DataFrame:
    w = observations_of(spark, d).select("type", F.explode(T.word_tokens(F.col("content"), 3)).alias("word")).where(~F.col("word").isin(STOP))
    c = w.groupBy("type", "word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return c.withColumn("_n", F.row_number().over(Window.partitionBy("type").orderBy(F.col("n").desc(), "word"))).where("_n <= 10").drop("_n")


_CDF = "1 / (1 + 0.2316419 * abs(z))"
_TAIL = f"exp(-abs(z) * abs(z) / 2) / 2.5066282746310002 * ({_CDF} * (0.319381530 + {_CDF} * (-0.356563782 + {_CDF} * (1.781477937 + {_CDF} * (-1.821255978 + {_CDF} * 1.330274429)))))"


@R.add(
    "ab_test",
    f"""WITH c AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0 AND value > 50)::BIGINT AS ha, count(*) FILTER (user_id % 2 = 0)::BIGINT AS na, count(*) FILTER (user_id % 2 = 1 AND value > 50)::BIGINT AS hb, count(*) FILTER (user_id % 2 = 1)::BIGINT AS nb FROM events GROUP BY 1),
    r AS (SELECT *, ha / na AS ra, hb / nb AS rb, sqrt((ha + hb) / (na + nb) * (1 - (ha + hb) / (na + nb)) * (1 / na + 1 / nb)) AS se FROM c), z AS (SELECT *, CASE WHEN se > 0 THEN (rb - ra) / se ELSE 0.0 END AS z FROM r),
    p AS (SELECT *, 2 * ({_TAIL}) AS pv FROM z)
    SELECT event_type, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(z, 6) AS z, round(pv, 6) AS p_value, CASE WHEN pv >= 0.05 THEN 'undecided' WHEN z > 0 THEN 'b' ELSE 'a' END AS decision FROM p""",
)
def ab_test(spark: SparkSession, d: str) -> DataFrame:
    """Users of even and odd ids as the two groups."""
    even, good = F.col("user_id") % 2 == 0, F.col("value") > 50
    c = table(spark, d, "events").groupBy("event_type").agg(F.count_if(even & good).alias("ha"), F.count_if(even).alias("na"), F.count_if(~even & good).alias("hb"), F.count_if(~even).alias("nb"))
    t = A.two_proportions(c, "ha", "na", "hb", "nb")
    return t.select("event_type", *[F.round(x, 6).alias(x) for x in ("rate_a", "rate_b", "z", "p_value")], "decision")


@R.add("latency_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(count(*) FILTER (value > 50) / count(*), 6) AS rate FROM events GROUP BY event_type")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("event_type")
    return g.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.count_if(F.col("value") > 50) / F.count(F.lit(1)), 6).alias("rate"))


@R.add(
    "item_gaps",
    "WITH u AS (SELECT DISTINCT l_suppkey % 50 AS shop, l_partkey % 400 AS item FROM lineitem), n AS (SELECT count(DISTINCT shop) AS n FROM u), c AS (SELECT item, count(*) AS users FROM u GROUP BY item) SELECT item, users, round(users / n * 100, 4) AS pct FROM c, n WHERE users > 1 AND users < n ORDER BY users DESC, item LIMIT 15",
)
def item_gaps(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("shop"), (F.col("l_partkey") % 400).alias("item")).distinct()
    c = u.groupBy("item").agg(F.count(F.lit(1)).alias("users")).join(F.broadcast(u.agg(F.countDistinct("shop").alias("n"))), F.lit(True))
    return c.where("users > 1 and users < n").orderBy(F.col("users").desc(), "item").limit(15).select("item", "users", F.round(F.col("users") / F.col("n") * 100, 4).alias("pct"))


_ENG = "CASE WHEN {0} >= 0 THEN ln(1 + {0}) ELSE 0.0 END"


@R.add(
    "engagement_score",
    f"""WITH r AS (SELECT event_id, CASE WHEN value IS NOT NULL THEN 0.55 * {_ENG.format('value')} + 0.40 * {_ENG.format("(props->>'k')::DOUBLE")} + 0.05 * 0.5 * 10 END AS raw, date_diff('day', ts::DATE, DATE '2024-02-01') AS age, user_id FROM events),
    b AS (SELECT min(raw) AS lo, max(raw) AS hi FROM r)
    SELECT event_id, round(raw, 6) AS raw, greatest(0, least(100, trunc(0.45 * trunc((user_id % 100)) + 0.25 * CASE WHEN age < 0 THEN 100 WHEN age >= 30 THEN 0 ELSE trunc(100 * (1 - age / 30)) END + 0.30 * coalesce(trunc((raw - lo) / (hi - lo) * 100), 35) - CASE WHEN raw IS NULL THEN 10 ELSE 0 END - 5)))::INTEGER AS score FROM r, b""",
)
def engagement_score(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("raw", A.forum_engagement(F.col("value"), F.get_json_object("props", "$.k").cast("double"), F.lit(None).cast("double")))
    e = A.min_max(e, "raw", "scaled")
    recency = A.recency_score(F.col("ts").cast("date"), F.lit("2024-02-01").cast("date"))
    score = A.overall_score((F.col("user_id") % 100) / 100 + 1e-9, recency, F.col("scaled"), F.col("raw"), F.lit("med"))
    return e.select("event_id", F.round("raw", 6).alias("raw"), score.alias("score"))


@R.add("recency_score", "SELECT event_id, CASE WHEN ts IS NULL THEN 0 WHEN age < 0 THEN 100 WHEN age >= 30 THEN 0 ELSE trunc(100 * (1 - age / 30)) END::INTEGER AS recency FROM (SELECT *, date_diff('day', ts::DATE, DATE '2024-01-20') AS age FROM events)")
def recency_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", A.recency_score(F.col("ts").cast("date"), F.lit("2024-01-20").cast("date")).cast("int").alias("recency"))


@R.add("date_range_filter", "SELECT event_id, CASE WHEN ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' THEN 'high' ELSE 'low' END AS confidence FROM events WHERE ts IS NULL OR ts::DATE >= DATE '2024-01-03'")
def date_range_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("ts is null or ts >= timestamp_ntz '2024-01-03 00:00:00'")
    return e.select("event_id", A.date_confidence(F.date_format("ts", "yyyy-MM-dd"), "2024-01-05", "2024-01-20").alias("confidence"))


@R.add("multi_sort", "SELECT event_id, row_number() OVER (ORDER BY value DESC, ts DESC, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS position FROM events QUALIFY position <= 50")
def multi_sort(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("value").desc(), F.col("ts").desc(), F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2), F.col("event_id")]
    first = table(spark, d, "events").orderBy(*order).limit(50)
    return first.select("event_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long").alias("position"))


_GRAMS = "list_distinct(CASE WHEN len(t) < 3 THEN [t] ELSE list_transform(range(1, len(t) - 1), lambda i: substr(t, i::BIGINT, 3)) END)"
_NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_PAIRS = f"""{_OBS}, n AS (SELECT id, confidence, {_NORMAL.format('content')} AS t FROM ob JOIN (SELECT id AS i2, min(confidence) AS confidence FROM observations GROUP BY 1) ON i2 = id WHERE content IS NOT NULL),
g AS MATERIALIZED (SELECT id, confidence, {_GRAMS} AS g FROM n WHERE t <> ''),
p AS (SELECT a.id AS key_a, b.id AS key_b, a.confidence AS ca, b.confidence AS cb, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS n FROM g a JOIN g b ON a.id < b.id AND least(len(a.g), len(b.g)) >= 0.7 * greatest(len(a.g), len(b.g))),
s AS (SELECT *, i / (n - i) AS similarity FROM p WHERE i / (n - i) >= 0.7)"""


def _grams(spark: SparkSession, d: str) -> DataFrame:
    # The text is made below the join, so the expression of each of its runs doesn't hold it.
    o = observations_of(spark, d).where("content is not null").select("id", A.normal_text(F.col("content")).alias("t")).where("t != ''")
    o = o.join(table(spark, d, "observations").groupBy("id").agg(F.min("confidence").alias("confidence")), "id")
    return o.withColumn("g", A.ngrams(F.col("t")))


@R.add("ngram_jaccard", f"WITH {_PAIRS} SELECT key_a, key_b, round(similarity, 6) AS similarity FROM s")
def ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return A.similar_pairs(_grams(spark, d), "id", "g", 0.7).withColumn("similarity", F.round("similarity", 6))


@R.add("near_dedupe", f"WITH {_PAIRS}, lost AS (SELECT CASE WHEN ca >= cb THEN key_b ELSE key_a END AS id FROM s) SELECT id FROM g WHERE id NOT IN (SELECT id FROM lost)")
def near_dedupe(spark: SparkSession, d: str) -> DataFrame:
    o = _grams(spark, d)
    return o.select("id").join(A.marked_duplicates(o, "id", "g", "confidence", 0.7), "id", "left_anti")


_CAPS = {"search": ["search", "find", "query"], "merge": ["merge", "join"], "clean": ["drop", "remove", "clean"]}


def _capability_sql() -> str:
    w = "list_distinct(" + _WORDS.format("content", 3) + ")"
    parts = " + ".join(f"CASE WHEN contains(lower(content), '{n}') THEN 15 ELSE 0 END + " + " + ".join(f"CASE WHEN list_contains({w}, '{t}') THEN 10 ELSE 0 END" for t in ts) for n, ts in [("merge", ["lease", "queue"])])
    return f"WITH {_OBS}, s AS (SELECT id, {parts} + least(10, len(list_intersect({w}, ['harbor', 'ledger', 'record', 'session', 'token']))) AS score FROM ob) SELECT id, score::INTEGER AS score FROM s WHERE score >= 5"


@R.add("capability_match", _capability_sql())
def capability_match(spark: SparkSession, d: str) -> DataFrame:
    """Name +15, each trigger word +10, word overlap +1 up to 10; from 5 on."""
    words = F.array_distinct(T.word_tokens(F.col("content"), 3))
    score = F.when(F.contains(F.lower("content"), F.lit("merge")), 15).otherwise(0)
    for t in ("lease", "queue"):
        score = score + F.when(F.array_contains(words, t), 10).otherwise(0)
    score = score + F.least(F.lit(10), F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ("harbor", "ledger", "record", "session", "token")]))))
    return observations_of(spark, d).where("content is not null").select("id", score.cast("int").alias("score")).where("score >= 5")


@R.add(
    "keyword_bigrams",
    f"WITH {_OBS}, w AS (SELECT id, list_filter({_WORDS.format('content', 2)}, lambda w: NOT list_contains([{_STOP}], w)) AS w FROM ob), g AS (SELECT unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w) SELECT term, count(*) AS n FROM g GROUP BY term ORDER BY n DESC, term LIMIT 50",
)
def keyword_bigrams(spark: SparkSession, d: str) -> DataFrame:
    w = observations_of(spark, d).select(F.filter(T.word_tokens(F.col("content"), 2), lambda x: ~x.isin(STOP)).alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    g = w.select(F.explode(F.concat("w", pairs)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "term").limit(50)


@R.add("keyword_density", f"SELECT doc_id, round((len(lower(text)) - len(replace(lower(text), 'queue', ''))) / 5 / nullif(len({_WORDS.format('text', 0)}), 0) * 100, 4) AS density FROM documents WHERE text IS NOT NULL")
def keyword_density(spark: SparkSession, d: str) -> DataFrame:
    n = (F.length(F.lower("text")) - F.length(F.replace(F.lower("text"), F.lit("queue"), F.lit("")))) / 5
    words = F.size(T.word_tokens(F.col("text")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(n / F.nullif(words, F.lit(0)) * 100, 4).alias("density"))


@R.add(
    "reading_ease",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w, len(regexp_split_to_array(text, '[.!?]+')) AS s FROM documents WHERE text IS NOT NULL),
    y AS (SELECT doc_id, len(w) AS n, s, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiou]+')) - CASE WHEN ends_with(x, 'e') THEN 1 ELSE 0 END))) AS y FROM w WHERE len(w) > 0)
    SELECT doc_id, n AS n_words, s AS n_sentences, round(greatest(0, least(100, 206.835e0 - 1.015e0 * n / s - 84.6e0 * y / n))::DOUBLE, 9) AS ease FROM y""",
)
def reading_ease(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    t = table(spark, d, "documents").where("text is not null").select("doc_id", words.alias("w"), F.size(F.split("text", "[.!?]+")).alias("s")).where("size(w) > 0")
    y = F.aggregate("w", F.lit(0), lambda a, x: a + T.syllables(x))
    ease = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * F.size("w") / F.col("s") - 84.6 * y / F.size("w")))
    return t.select("doc_id", F.size("w").cast("long").alias("n_words"), F.col("s").cast("long").alias("n_sentences"), F.round(ease, 9).alias("ease"))


_GOOD, _BAD = ["healthy", "robust", "fresh", "early"], ["broken", "stale", "slow", "late"]


@R.add("sentiment", f"WITH {_OBS}, w AS (SELECT id, {_WORDS.format('content', 0)} AS w FROM ob), c AS (SELECT id, len(list_filter(w, lambda x: list_contains({_GOOD!r}, x))) AS p, len(list_filter(w, lambda x: list_contains({_BAD!r}, x))) AS n FROM w), s AS (SELECT id, CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n) END AS s FROM c) SELECT id, round(s::DOUBLE, 6) AS score, CASE WHEN s > 0.3 THEN 'positive' WHEN s < -0.3 THEN 'negative' ELSE 'neutral' END AS label FROM s")
def sentiment(spark: SparkSession, d: str) -> DataFrame:
    s = observations_of(spark, d).select("id", A.lexicon_sentiment(T.word_tokens(F.col("content")), _GOOD, _BAD).alias("s"))
    return s.select("id", F.round("s", 6).alias("score"), F.when(F.col("s") > 0.3, "positive").when(F.col("s") < -0.3, "negative").otherwise("neutral").alias("label"))


_PATTERNS = [("date", "low", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), ("path", "medium", r"[a-z]+/[a-z_]+\.(?:py|ts|java|md)"), ("secret", "high", r"(?:token|secret)=[A-Za-z0-9]{8,}")]
_WEIGHTS = {"high": 25, "medium": 8, "low": 3}
_SCAN = (
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL), h AS ("
    + " UNION ALL ".join(f"SELECT doc_id, line_no, '{n}' AS pattern, '{s}' AS severity, left(regexp_replace(line, '{rx}', '***', 'g'), 80) AS snippet FROM l WHERE regexp_matches(line, '{rx}')" for n, s, rx in _PATTERNS)
    + "), f AS (SELECT * FROM h)"
)


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return A.pattern_scan(table(spark, d, "documents").where("text is not null"), F.col("doc_id"), F.col("text"), _PATTERNS).withColumnRenamed("key", "doc_id")


@R.add("pattern_scan", _SCAN + " SELECT doc_id, line_no::INTEGER AS line_no, pattern, severity, snippet FROM f")
def pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d)


@R.add("severity_score", _SCAN + " SELECT doc_id, greatest(0, 100 - sum(CASE severity WHEN 'high' THEN 25 WHEN 'medium' THEN 8 ELSE 3 END))::BIGINT AS score FROM f GROUP BY doc_id")
def severity_score(spark: SparkSession, d: str) -> DataFrame:
    return A.severity_score(_scan(spark, d), "doc_id", _WEIGHTS)


_DOMAINS = {"storage": ["depot", "cask", "cellar"], "search": ["query", "index", "lexicon"], "text": ["paragraph", "footer", "docstring"]}
_DC = {n: " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in ws) for n, ws in _DOMAINS.items()}


@R.add("domain_route", "WITH c AS (SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _DC.items()) + " FROM documents WHERE text IS NOT NULL), b AS (SELECT *, greatest(storage, search, text) AS m FROM c) SELECT doc_id, CASE WHEN m = 0 THEN 'style' WHEN storage = m THEN 'storage' WHEN search = m THEN 'search' ELSE 'text' END AS domain FROM b")
def domain_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", A.domain_of(F.col("text"), _DOMAINS, "style").alias("domain"))


# --- text ------------------------------------------------------------------------------------

_MEM = "m AS (SELECT key, unnest(max({'u': updated_at, 'content': content})) FROM memories GROUP BY key)"


def _memories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").groupBy("key").agg(F.max(F.struct("updated_at", "content")).alias("m")).select("key", "m.content")


@R.add("line_hash", f"WITH {_MEM}, l AS (SELECT key, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM m) SELECT key, n::INTEGER AS line_no, lpad(n::VARCHAR, 4, ' ') || ' | ' || left(sha256(line), 6) || ' | ' || line AS numbered FROM l")
def line_hash(spark: SparkSession, d: str) -> DataFrame:
    lines = _memories(spark, d).select("key", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    n = F.col("i") + 1
    return lines.select("key", n.alias("line_no"), F.concat(F.lpad(n.cast("string"), 4, " "), F.lit(" | "), T.line_hash(F.col("line")), F.lit(" | "), F.col("line")).alias("numbered"))


_WS = r"array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), lambda x: x <> ''), chr(10))"


@R.add("ws_normalize", f"WITH {_MEM} SELECT key, md5({_WS.format('content')}) AS text_md5 FROM m WHERE content IS NOT NULL")
def ws_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _memories(spark, d).where("content is not null").select("key", F.md5(T.normalize_whitespace(F.col("content"))).alias("text_md5"))


@R.add("strip_frontmatter", r"SELECT doc_id, md5(regexp_replace(text, '(?s)\A---\s*\n.*?\n---\s*\n', '')) AS text_md5, starts_with(text, '---') AS had FROM documents WHERE text IS NOT NULL")
def strip_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.strip_frontmatter(F.col("text"))).alias("text_md5"), F.startswith("text", F.lit("---")).alias("had"))


@R.add(
    "skill_meta",
    r"""WITH f AS (SELECT doc_id, text, regexp_extract(text, '(?s)\A---\s*\n(.*?)\n---', 1) AS fm FROM documents WHERE text IS NOT NULL),
    x AS (SELECT doc_id, regexp_replace(trim(regexp_extract(fm, '(?m)^name:\s*(.+)$', 1)), '^"+|"+$', '', 'g') AS n, regexp_replace(trim(regexp_extract(fm, '(?m)^description:\s*(.+)$', 1)), '^"+|"+$', '', 'g') AS de, trim(regexp_extract(text, '(?m)^#\s+(.+)$', 1)) AS h FROM f)
    SELECT doc_id, CASE WHEN n <> '' THEN n WHEN h <> '' THEN h ELSE doc_id::VARCHAR END AS name, de AS description FROM x""",
)
def skill_meta(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    name = T.front_field(F.col("text"), "name")
    return t.select("doc_id", F.when(name != "", name).otherwise(T.title(F.col("text"), F.col("doc_id").cast("string"))).alias("name"), T.front_field(F.col("text"), "description").alias("description"))


@R.add(
    "skeleton",
    """WITH one AS (SELECT id, unnest(max({'a': ingested_at, 'signature': signature, 'docstring': docstring, 'raw_body': raw_body})) FROM nodes GROUP BY id)
    SELECT id, md5(concat_ws(chr(10), signature, CASE WHEN trim(docstring, ' ') <> '' THEN '    \"\"\"' || docstring || '\"\"\"' END)) AS standard_md5,
    md5(CASE WHEN len(string_split(raw_body, chr(10))) > 5 THEN array_to_string(string_split(raw_body, chr(10))[1:5], chr(10)) || chr(10) || '...' ELSE raw_body END) AS short_md5 FROM one""",
)
def skeleton(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").groupBy("id").agg(F.max(F.struct("ingested_at", "signature", "docstring", "raw_body")).alias("m")).select("id", "m.*")
    s = lambda detail: F.md5(T.skeleton(F.col("signature"), F.col("docstring"), F.col("raw_body"), detail))
    return n.select("id", s("standard").alias("standard_md5"), s("short").alias("short_md5"))


@R.add("node_ids", "SELECT fqn, min(id) AS id FROM nodes WHERE type = 'module' GROUP BY fqn")
def node_ids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based identifiers of modules, computed from their qualified names."""
    return table(spark, d, "nodes").where("type = 'module'").select("fqn", T.uuid5_url(F.col("fqn")).alias("id")).distinct()
