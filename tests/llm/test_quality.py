import math

from pyspark.sql import functions as F

from hybridlake.llm import quality
from hybridlake.llm.quality import Judge

PROSE = "The old design kept the worker in the queue, and nobody had noticed it until the end of the week. We decided to change this because it was slow."


def share(text):
    return Judge().text(text)[5]


def test_prose_in_any_layout():
    for text in (
        PROSE, PROSE.upper(), PROSE.lower().replace(".", ""), PROSE.replace(", ", ",\n"), "reviewer: " + PROSE, "- " + PROSE + "\n- " + PROSE[:90],
        "Wir haben den neuen Katalog entfernt, und seitdem läuft der Speicher deutlich schneller.",
        "우리는 오래된 방식을 버리고 세션 기준으로 다시 묶어서 정리합니다. 그래서 함수 쪽에는 따로 손댈 일이 없습니다.",
        "You can call `rebuild_index_now` if the cache_manager of the node is not available on your machine.",
        "El resumen no coincide con lo que decía el párrafo y por eso se cambió.", "Il faut garder le résumé avec son journal, parce que les deux sont vérifiés.",
    ):
        assert share(text) > 0.7, text


def test_lists_tables_and_junk():
    for text in (
        "- red box\n- blue box\n- green box", "| a | b |\n|---|---|\n| 1 | 2 |", "a\tb\tc\n1\t2\t3", "x ....... 1\nyy ....... 2", "fJZDvB+hwq5Cdf/ooxPEawmAfT4CEFil" * 9,
        "T h e f u n c t i o n i s n o t d o n e", ".a{margin:1;color:#fff}.b{margin:2}", "The same sentence is here again.\n" * 9, "ê²½ê³\x84 ì\x83\x81í\x83\x9c ë\x9d¼ë©´",
        "word " * 200, "box cart lamp horse tree wheel grass stone river cloud", "00000000  ce 1a 0d 5c\n00000010  5b cd 18 b1", "a) Rahmen; Filter\nb) Takt; Index", "WARN [x-1] do_it id=12 took=4ms",
    ):
        assert share(text) < 0.5, text


def test_edge_texts():
    assert Judge().text(None) == Judge().text(" \n\t ") == (0, None, None, None, None, None)
    assert share(" ".join(f"The part{i} of it was not in the list{i} when we had a look at that." for i in range(20_000))) > 0.9
    assert share(PROSE * 5000) < 0.1
    assert Judge().text("123 456")[:2] == (0, 0.0)


def brute_scores(rows):
    out = []
    for r in rows:
        mates = [x for x in rows if x["language"] == r["language"]]
        s = 0.0
        for c in quality.STATISTICS:
            v = [round(float(x[c]), 9) for x in mates]
            x = round(float(r[c]), 9)
            s -= math.log(min(sum(y <= x for y in v), sum(y >= x for y in v)) / len(v))
        out.append(round(s, 9))
    return sorted(out)


def test_exact_ranks(spark):
    texts = [PROSE[: 20 + 7 * i] for i in range(18)] + ["- a\n- b"] * 14 + ["| 1 | 2 |", None, " "] + [PROSE] * 2
    rows = [(i if i % 9 else None, ["en", "EN-us", None, "de", "xx1"][i % 5], t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, language string")
    stats = quality.statistics(df, F.col("doc_id"), F.col("lang"), F.col("text"))
    got = quality.outlier_scores(stats, least_group=1).collect()
    assert len(got) == len(rows) and sum(r.outlier_score is None for r in got) == 2
    assert {r.language for r in got} == {"en", "de", "und"}
    assert sorted(round(r.outlier_score, 9) for r in got if r.outlier_score is not None) == brute_scores([r for r in got if r.outlier_score is not None])
    junk = df.where("text like '|%' or text like '-%'").count()
    prose = df.unionByName(spark.createDataFrame([(100 + i, "en", f"{PROSE} It is the {i}th of them. " * (1 + i % 4), "clash") for i in range(60)], df.schema))
    more = quality.outlier_scores(quality.statistics(prose, F.col("doc_id"), F.col("lang"), F.col("text")))
    assert quality.found(more).count() >= junk
    assert quality.outlier_scores(quality.statistics(df.limit(0), F.col("doc_id"), F.col("lang"), F.col("text"))).count() == 0


def test_junk_that_is_most_of_its_language_is_found(spark):
    rows = [(i, "es", "| 1 | 2 |\n| 3 | 4 |") for i in range(95)] + [(100 + i, "es", f"{PROSE} It is the {i}th of them.") for i in range(5)] + [(200, "es", None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    scored = quality.outlier_scores(quality.statistics(df, F.col("doc_id"), F.col("lang"), F.col("text")))
    assert {r.doc_id for r in quality.found(scored).collect()} == set(range(95))


def test_small_languages_are_ranked_by_themselves(spark):
    rows = [(i, "de" if i < 5 else None, f"{PROSE} " * (1 + i % 3) + "- a\n" * (i % 4)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = quality.outlier_scores(quality.statistics(df, F.col("doc_id"), F.col("lang"), F.col("text"))).collect()
    assert sorted(round(r.outlier_score, 9) for r in got) == brute_scores(got)


def test_outlier_score_decides_in_doubt(spark):
    rows = [(1, 0.1, 0.0), (2, 0.45, 2.0), (3, 0.45, 4.0), (4, 0.55, 8.0), (5, 0.55, 9.5), (6, 0.75, 50.0), (7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, share_prose double, outlier_score double")
    assert {r.doc_id for r in quality.found(df).collect()} == {1, 3, 5}
