"""Canonical JSON against published vectors; frames out of bytes cut anywhere."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from maskframe.functions import canonical as J
from maskframe.operators import audit
from maskframe.streaming import frames as S

# Doubles by their bits and how ECMAScript writes them (RFC 8785, appendix B).
NUMBERS = {
    "0000000000000000": "0", "8000000000000000": "0", "0000000000000001": "5e-324", "8000000000000001": "-5e-324",
    "7fefffffffffffff": "1.7976931348623157e+308", "ffefffffffffffff": "-1.7976931348623157e+308", "4340000000000000": "9007199254740992",
    "c340000000000000": "-9007199254740992", "4430000000000000": "295147905179352830000", "44b52d02c7e14af5": "9.999999999999997e+22",
    "44b52d02c7e14af6": "1e+23", "44b52d02c7e14af7": "1.0000000000000001e+23", "444b1ae4d6e2ef4e": "999999999999999700000",
    "444b1ae4d6e2ef4f": "999999999999999900000", "444b1ae4d6e2ef50": "1e+21", "3eb0c6f7a0b5ed8c": "9.999999999999997e-7",
    "3eb0c6f7a0b5ed8d": "0.000001", "41b3de4355555553": "333333333.3333332", "41b3de4355555554": "333333333.33333325",
    "41b3de4355555555": "333333333.3333333", "41b3de4355555556": "333333333.3333334", "41b3de4355555557": "333333333.33333343",
    "becbf647612f3696": "-0.0000033333333333333333", "43143ff3c1cb0959": "1424953923781206.2",
}


@pytest.mark.parametrize("bits", NUMBERS)
def test_numbers(bits):
    assert J.number(struct.unpack(">d", bytes.fromhex(bits))[0]) == NUMBERS[bits]


def test_numbers_read_back():
    draw = random.Random(3)
    for _ in range(2000):
        x = struct.unpack(">d", draw.randbytes(8))[0]
        if x == x and abs(x) != float("inf"):
            assert float(J.number(x)) == x
    for x in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            J.number(x)


def test_keys_by_utf16_units_and_escapes():
    value = {"€": "Euro", "\r": "CR", "\ufb33": "Hebrew", "1": "One", "\U0001f600": "Smile", "\u0080": "Control", "ö": "o"}
    assert [*json.loads(J.dumps(value))] == ["\r", "1", "\u0080", "ö", "€", "\U0001f600", "\ufb33"]
    text = J.dumps(json.loads('{"numbers":[333333333.33333329,1E30,4.50,2e-3,0.000000000000000000000000001],"string":"\\u20ac$\\u000F\\u000aA\'\\u0042\\u0022\\u005c\\\\\\"\\/","literals":[null,true,false]}'))
    assert text == '{"literals":[null,true,false],"numbers":[333333333.3333333,1e+30,4.5,0.002,1e-27],"string":"€$\\u000f\\nA\'B\\"\\\\\\\\\\"/"}'
    with pytest.raises(ValueError):
        J.dumps("\ud800")


def test_records(spark):
    df = spark.sql("select 1.5D d, cast(0.1 as float) f, 12.50BD n, map('b', 1, 'a', 2) m, named_struct('z', 1e21D, 'a', array(0.1D, null)) s, 'x\\u001fy' t, 9007199254740993L big, 7L small")
    line = df.select(audit.canonical(df, *df.columns)).first()[0]
    assert line == '{"big":9007199254740992,"d":1.5,"f":0.10000000149011612,"m":{"a":2,"b":1},"n":12.5,"s":{"a":[0.1,null],"z":1e+21},"small":7,"t":"x\\u001fy"}'
    assert df.select(audit.canonical(df, "t", "small")).first()[0] == '{"small":7,"t":"x\\u001fy"}'
    assert df.select(audit.canonical(df, "big")).first()[0] == '{"big":9007199254740992}'
    for bad in ("double('NaN')", "array(double('Infinity'))", "map('a', double('-Infinity'))", "named_struct('x', array(named_struct('y', float('NaN'))))"):
        odd = spark.sql(f"select {bad} v")
        with pytest.raises(Exception, match="no such number"):
            odd.select(audit.canonical(odd, "v")).collect()
    null = spark.sql("select cast(null as double) v, cast(null as array<double>) a")
    assert null.select(audit.canonical(null, "v", "a")).first()[0] == '{"a":null,"v":null}'
    assert "ArrowEvalPython" in df.select(audit.canonical(df, "d"))._jdf.queryExecution().executedPlan().toString()


BODY = "event: delta\ndata: {\"t\": \"Ayşe \U0001f600\"}\n\ndata: one\r\ndata: two\r\n\r\n: remark\n\n\n\ndata:x\r\n\ndata: [DONE]".encode()


def plain(body):
    out, at = [], 0
    for m in S._END.finditer(body):
        out.append((body[at : m.start()].decode("utf-8", "replace"), m[0].decode()))
        at = m.end()
    return out + ([(body[at:].decode("utf-8", "replace"), "")] if body[at:] else [])


def test_any_cut_gives_the_same_frames(spark, tmp_path):
    draw, rows, bodies = random.Random(8), [], {}
    for r in range(30):
        body = bodies[f"r{r}"] = BODY if r < 25 else BODY + b"\n\ndata: \xc5" + b"\n\n" * (r - 25)
        cuts = sorted(draw.sample(range(len(body) + 1), min(r * 4, len(body)))) if r else []
        edges = [0, *cuts, len(body)] if r != 1 else list(range(len(body) + 1))
        parts = [(f"r{r}", i, body[a:b], i == len(edges) - 2) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
        rows += parts + draw.sample(parts, len(parts) // 3)
    draw.shuffle(rows)
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(rows[i::3], S.PIECES).coalesce(1).write.mode("append").parquet(source)
    stream = S.frame_stream(spark.readStream.schema(S.PIECES).option("maxFilesPerTrigger", 1).parquet(source))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(150)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.resp_id, []).append(r)
    assert set(got) == set(bodies)
    for name, body in bodies.items():
        mine = sorted(got[name], key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(len(mine))) and [(r.frame, r.separator) for r in mine] == plain(body)
    first = sorted(got["r0"], key=lambda r: r.n)
    assert [(r.event, r.data) for r in first[:2]] == [("delta", '{"t": "Ayşe \U0001f600"}'), (None, "one\ntwo")] and first[-1].data == "[DONE]"


def test_limits_and_null_bodies(spark, tmp_path):
    rows = [("a", 0, b"data: " + b"x" * 100, False), ("a", 1, b"\n\n", True), ("b", 0, None, False), ("b", 1, b"data: y", True), ("b", 2, b"late", False)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, S.PIECES).coalesce(1).write.parquet(source)
    q = S.frame_stream(spark.readStream.schema(S.PIECES).parquet(source), 50).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.resp_id, r.data, r.error_code) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.resp_id == "b")
    assert got == [("b", "y", None)]
    wide = spark.createDataFrame([("c", 3, b"z" * 80, False)], S.PIECES)
    wide.coalesce(1).write.mode("append").parquet(source)
    q = S.frame_stream(spark.readStream.schema(S.PIECES).parquet(source), 50).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert ("c", "BUFFER_LIMIT") in {(r.resp_id, r.error_code) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
