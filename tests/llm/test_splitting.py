from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hybridlake.llm.splitting import split_oversized, split_text


def check(text, limit, overlap):
    cuts = split_text(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in cuts) == text
    for i, (s, b, e) in enumerate(cuts):
        assert 0 < e - s <= limit and s <= b < e and b - s <= overlap
        assert i == 0 or (b == cuts[i - 1][2] and s >= cuts[i - 1][0])
    return cuts


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n\r#é́。", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_places():
    text = "# One\n" + "First sentence here. " * 5 + "\n\n# Two\n" + "Second part follows. " * 5
    cuts = check(text, 130, 30)
    assert text[cuts[1][1] :].startswith("# Two")
    assert text[cuts[1][0] : cuts[1][1]].strip() in text and cuts[1][0] < cuts[1][1]


def test_without_boundaries_and_very_long():
    cuts = check("x" * 10_000, 2500, 400)
    assert len(cuts) == 5 and all(b - s == 400 for s, b, _ in cuts[1:])
    check("word " * 200_000, 2500, 400)


def test_operator(spark):
    rows = [("t", "long", "ab cd. " * 1000, 1), ("t", "fits", "x" * 2500, 1), ("t", "null", None, 1), (None, None, "é" * 2501, 1), ("t", "empty", "", 1)]
    df = spark.createDataFrame(rows, "a string, b string, c string, piece int")
    got = split_oversized(df, F.col("a"), F.col("b"), F.col("c")).collect()
    assert {r.item_key for r in got} == {"long", None}
    assert all(len(r.piece) <= 2500 for r in got)
    mine = sorted((r for r in got if r.item_key == "long"), key=lambda r: r.piece_no)
    assert "".join(r.piece[r.n_overlap :] for r in mine) == rows[0][2]
    assert split_oversized(df.limit(0), F.col("a"), F.col("b"), F.col("c")).count() == 0
