import json
import os

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hybridlake.operators.chunking import chunk_lines, chunk_table, chunks
from hybridlake.operators.editing import find_block, find_blocks, replace_block
from hybridlake.operators.lanes import replay, replay_todos
from hybridlake.streaming import jobs

LOG = [
    (1, "x", "a", "acquire", None, 0.0), (2, "x", "b", "acquire", None, 10.0), (3, "x", "a", "acquire", None, 20.0), (4, "x", "b", "release", None, 30.0), (5, "x", "a", "release", "c", 40.0),
    (6, "x", "b", "acquire", None, 50.0), (7, "x", "c", "acquire", None, 60.0), (8, "x", "b", "acquire", None, 60.0 + 7201), (9, "x", None, "force", None, 8000.0), (10, "y", "a", "acquire", None, 1.0), (11, "y", "a", "release", None, 2.0),
]
WANT = {1: (True, "BUSY", "a"), 2: (False, "BUSY", "a"), 3: (True, "BUSY", "a"), 4: (False, "BUSY", "a"), 5: (True, "HANDOFF", None), 6: (False, "HANDOFF", None), 7: (True, "BUSY", "c"), 8: (True, "BUSY", "b"), 9: (True, "IDLE", None), 10: (True, "BUSY", "a"), 11: (True, "IDLE", None)}
SCHEMA = "seq long, lane string, agent string, op string, handoff_to string, at double"


def test_chunks():
    assert chunks(None) == chunks("") == [""] and chunks("short") == ["short"] and chunks("x" * 2500) == ["x" * 2500]
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(20))
    parts = chunks(text)
    assert len(parts) > 1 and all(len(p) <= 2500 for p in parts) and parts[1].split("\n\n")[0] in parts[0] + " "
    one = chunks(".a{b:c;}" * 1000)
    assert all(len(p) <= 2500 for p in one) and all(p.endswith(".") for p in one[:-1])
    assert len(chunks("x" * 6000)) == 3 or all(len(p) <= 2500 for p in chunks("x" * 6000))
    assert chunk_lines("a\nb\nc", ["a\nb\nc"]) == [(1, 3)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. \n;}", max_size=400))
def test_chunks_keep_limit_and_end(text):
    parts = chunks(text, 60, 12)
    assert all(len(p) <= 60 for p in parts) or len(text) <= 60 or text.isspace()


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "a b. " * 1000, "k"), (2, None, "k"), (3, "", "k")], "id long, text string, key string")
    got = chunk_table(df, F.col("id"), F.col("text")).collect()
    assert {r.key for r in got} == {1, 2, 3} and sum(r.key == 1 for r in got) > 2
    assert chunk_table(df.limit(0), F.col("id"), F.col("text")).count() == 0


def test_fuzzy_edit(spark):
    text = "def f():\n    x  = 1\n\n    return x\nend"
    assert replace_block(text, "return x", "pass")[1] == "exact"
    assert find_block(text, "x = 1\n\n  return   x") == (9, 33)
    assert replace_block(text, "x = 1\n\nreturn x", "y")[0] == "def f():\ny\nend" and replace_block(text, "absent", "y") == (None, "missing")
    df = spark.createDataFrame([(1, text, "x = 1\n\nreturn x"), (2, None, "x"), (3, text, "")], "id long, t string, b string")
    assert [tuple(r) for r in find_blocks(df, F.col("id"), F.col("t"), F.col("b")).collect()] == [(1, 9, 33)]


def test_lane_replay(spark):
    got = replay(spark.createDataFrame(LOG, SCHEMA)).collect()
    assert {r.seq: (r.accepted, r.status, r.holder) for r in got} == WANT
    assert replay(spark.createDataFrame([], SCHEMA)).count() == 0


def test_todos(spark):
    log = spark.createDataFrame([(1, "add", None, "old"), (2, "clear", None, None), (3, "add", None, "a"), (4, "add", None, "b"), (5, "check", 2, None), (6, "check", 9, None)], "seq long, op string, id long, task string")
    assert {tuple(r) for r in replay_todos(log).collect()} == {(1, "a", False), (2, "b", True)}


def _stream(spark, path, rows, schema, build, mode="append"):
    path.mkdir()
    for i, part in enumerate(rows):
        (path / f"{i}.json").write_text("\n".join(json.dumps(r) for r in part))
        os.utime(path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in order of age
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))
    name = "out_" + path.name
    q = build(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path) + "_ckpt").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_lanes(spark, tmp_path):
    keys = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [[dict(zip(keys, r, strict=True)) for r in part] for part in (LOG[:4], LOG[4:8], LOG[8:])]
    got = _stream(spark, tmp_path / "lanes", rows, SCHEMA, jobs.lane_states).collect()
    assert {r.seq: (r.accepted, r.status, r.holder) for r in got} == WANT


def test_stream_batches_and_repeats(spark, tmp_path):
    t = lambda s: pd.Timestamp("2025-01-01") + pd.Timedelta(seconds=s)
    events = [[{"path": p, "at": str(t(s))} for p, s in part] for part in ([("a", 0), ("b", 3), ("a", 4)], [("c", 60)], [("z", 600)], [("z", 1200)])]
    schema = "path string, at timestamp"
    got = [r.paths for r in _stream(spark, tmp_path / "batches", events, schema, jobs.change_batches).orderBy("start").collect()]
    assert got[:2] == [["a", "b"], ["c"]]
    once = [r.path for r in _stream(spark, tmp_path / "repeats", events[:2], schema, jobs.suppress_repeats).collect()]
    assert sorted(once) == ["a", "b", "c"]
    n = {r.key: r.n for r in _stream(spark, tmp_path / "counts", [[{"key": "a"}, {"key": "b"}], [{"key": "a"}]], "key string", jobs.access_counts, "complete").collect()}
    assert n == {"a": 2, "b": 1}
