import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskframe.operators import chat
from maskframe.operators.mask import restore
from maskframe.plans.streams import drained
from maskframe.streaming import jobs

VALUES = {"[KISI_1]": "Ayşe", "[KISI_1]#0123456789abcdef": "Ali", "[TEL_12]": "5"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["[KISI_1]", "[KISI_1]#0123456789abcdef", "[", "]", "[KISI", "_1]", "#01", "[TEL_12]", " ", "x", "👩"]), max_size=12), st.randoms(use_true_random=False))
def test_any_cut_equals_the_whole(pieces, rng: random.Random):
    text = "".join(pieces)
    out, buffer, at = "", "", 0
    while at < len(text):
        to = at + rng.randint(1, 5)
        ready, buffer = jobs.cut(buffer + text[at:to], False)
        out += restore(ready, VALUES)
        at = to
    ready, buffer = jobs.cut(buffer, True)
    assert out + restore(ready, VALUES) == restore(text, VALUES) and buffer == ""


def grants(spark, *responses):
    return spark.createDataFrame([(r, p, v) for r in responses for p, v in VALUES.items()], "resp_id string, placeholder string, value string")


def test_stream_restores_out_of_order_chunks_and_json(spark, tmp_path):
    rows = [("r", "c", 1, "SI_1] b", "text", False), ("r", "c", 0, "a [KI", "text", False), ("r", "c", 2, "!", "text", True), ("r", "j", 0, '{"a":"[KIS', "json", False), ("r", "j", 1, 'I_1]"}', "json", True)]
    spark.createDataFrame(rows, jobs.CHUNKS).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(jobs.CHUNKS).parquet(str(tmp_path / "in"))
    out = drained(jobs.restore_stream(source, grants(spark, "r"), idle_ms=None), str(tmp_path / "run")).orderBy("field_key", "seq").collect()
    text = "".join(r.text for r in out if r.field_key == "c")
    assert text == "a Ayşe b!" and [r.text for r in out if r.field_key == "j"] == ['{"a":"Ayşe"}']


def test_buffer_limit(spark, tmp_path):
    spark.createDataFrame([("r", "j", 0, "x" * 50, "json", False)], jobs.CHUNKS).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(jobs.CHUNKS).parquet(str(tmp_path / "in"))
    out = drained(jobs.restore_stream(source, grants(spark, "r"), max_buffer=10, idle_ms=None), str(tmp_path / "run")).collect()
    assert [r.error_code for r in out] == ["BUFFER_LIMIT"]


def test_responses_restore_their_own_and_no_more_than_their_budget(spark, tmp_path):
    rows = [("r", "c", 0, "[KISI_1] [TEL_12]", "text", True), ("s", "c", 0, "[KISI_1] [TEL_12]", "text", True), ("t", "a", 0, "[KISI_1]", "text", True), ("t", "b", 0, "x [KISI_1] y", "text", True), ("u", "a", 0, "[KISI_1][TEL_12]", "text", False)]
    spark.createDataFrame(rows, jobs.CHUNKS).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(jobs.CHUNKS).parquet(str(tmp_path / "in"))
    given = spark.createDataFrame([("r", "[KISI_1]", "Ali"), ("s", "[KISI_1]", "Can"), ("t", "[KISI_1]", "Ece"), ("u", "[KISI_1]", "Nur"), ("u", "[TEL_12]", "5")], "resp_id string, placeholder string, value string")
    out = {(r.resp_id, r.field_key): (r.text, r.error_code) for r in drained(jobs.restore_stream(source, given, budget=1, idle_ms=None), str(tmp_path / "run")).collect()}
    assert out == {("r", "c"): ("Ali [TEL_12]", None), ("s", "c"): ("Can [TEL_12]", None), ("t", "a"): ("Ece", None), ("t", "b"): (None, "UNMASK_LIMIT"), ("u", "a"): ("Nur", None)}


def test_limit_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", s) for s in (0, 1, 2, 60, 61)], "k string, s int").select("k", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs="s")).alias("t"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = drained(jobs.limit_stream(source, "k", "t", 2, 60_000, expire=False), str(tmp_path / "run")).orderBy("at").collect()
    assert [r.allowed for r in out] == [True, True, False, True, True]


def test_delta_fields(spark):
    frame = '{"id":"r","choices":[{"index":0,"delta":{"content":"hi","tool_calls":[{"index":1,"function":{"arguments":"{}"}}]}}]}'
    got = {(r.field_key, r.text, r.fmt) for r in chat.delta_fields(spark.createDataFrame([(0, frame)], "seq long, data string")).collect()}
    assert got == {("choice.0.content", "hi", "text"), ("choice.0.tool.1", "{}", "json")}


@pytest.mark.parametrize("tail", ["[", "[KISI", "[KISI_", "[KISI_12", "[KISI_1]", "[KISI_1]#01"])
def test_open_tails_wait(tail):
    assert jobs.cut("x" + tail, False) == ("x", tail)


def test_chunks_that_come_again_change_nothing(spark, tmp_path):
    grants = spark.createDataFrame([("r", "[KISI_1]", "Ali"), ("r", "[KISI_2]", "Veli")], "resp_id string, placeholder string, value string")
    a = [("r", "a", 0, "Hi [KI", "text", False), ("r", "a", 1, "SI_1] and", "text", False), ("r", "a", 2, " [KISI_2]!", "text", True)]
    b = [("r", "b", 0, "x [KISI_1] ", "text", False), ("r", "b", 1, "y", "text", True)]
    batches = [[a[0], b[0]], [a[1], a[0], a[0]], [a[2], a[1], b[0]], [a[0], a[1], a[2], b[1]], [a[0], b[1]]]
    source = tmp_path / "in"
    got = []
    for rows in batches:
        spark.createDataFrame(rows, jobs.CHUNKS).coalesce(1).write.mode("append").parquet(str(source))
        stream = jobs.restore_stream(spark.readStream.schema(jobs.CHUNKS).parquet(str(source)), grants, idle_ms=None)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.append((r.field_key, r.seq, r.text))
    assert "".join(t for f, _, t in sorted(got) if f == "a") == "Hi Ali and Veli!" and "".join(t for f, _, t in sorted(got) if f == "b") == "x Ali y"
    assert len({g[:2] for g in got}) == len(got)
