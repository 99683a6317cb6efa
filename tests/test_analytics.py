from hybridlake.plans import analytics_queries


def test_scan_and_score_count_every_finding(spark, tmp_path):
    late = ["at 2025-01-01"] * 20 + ["token=abcdefgh1 on 2025-01-02", "plain"]
    many = ["see docs/a.md"] * 5 + ["at 2025-01-01"] * 250
    rows = [(1, "\n".join(late)), (2, "\n".join(many)), (3, "plain"), (4, None), (5, "secret=abcdefgh1")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = analytics_queries.pattern_scan(spark, str(tmp_path)).collect()
    assert len(found) == 22 + 255 + 1
    assert {(r.line_no, r.pattern) for r in found if r.doc_id == 1 and r.line_no > 20} == {(21, "date"), (21, "secret")}
    assert max(r.line_no for r in found if r.doc_id == 2) == 255
    score = {r.doc_id: r.score for r in analytics_queries.severity_score(spark, str(tmp_path)).collect()}
    assert score == {1: 100 - 21 * 3 - 25, 2: 0, 5: 75}
