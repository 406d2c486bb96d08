"""The streamed vault against a spelled-out one and against the batch operators."""

import random
import time
from collections import OrderedDict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskframe.functions import placeholders as P
from maskframe.operators import vault as batch
from maskframe.streaming import vault as V

START = datetime(2024, 1, 1)


def run(spark, tmp_path, make, rows, schema, files=1):
    """Feeds ``rows`` as several files, one a micro-batch, and returns what came out in order of files."""
    source, step = tmp_path / "in", max(1, -(-len(rows) // files))
    for i in range(files):
        part = rows[i * step : (i + 1) * step]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


class Model:
    """A scope's vault, one dictionary in the order of use."""

    def __init__(self, ttl, capacity):
        self.ttl, self.capacity, self.held, self.last = ttl, capacity, OrderedDict(), {}

    def step(self, op, at, type_, label, value, placeholder):
        if op == "resolve":
            got = self.held.get(placeholder)
            if got is None or got[2] <= at:
                self.held.pop(placeholder, None)
                return [(op, placeholder, None, "UNRESOLVED")]
            self.held.move_to_end(placeholder)
            return [(op, placeholder, got[1], "RESOLVED")]
        for p, (t, v, ends) in self.held.items():
            if (t, v) == (type_, value) and ends > at:
                self.held.move_to_end(p)
                return [(op, p, value, "KNOWN")]
        family = label
        given = placeholder if placeholder and placeholder not in self.held else None
        if given is None:
            n = self.last.get(family, 0)
            if placeholder:
                n = max(n, P.parts_of(placeholder)[2])
            given = P.spell(label, n + 1)
        self.last[family] = max(self.last.get(family, 0), P.parts_of(given)[2])
        self.held[given] = (type_, value, at + self.ttl)
        out = [(op, given, value, "NEW")]
        while len(self.held) > self.capacity:
            out.append(("evict", self.held.popitem(last=False)[0], None, "EVICTED"))
        return out


def events(n=400, scopes=3, seed=4):
    draw, rows = random.Random(seed), []
    for i in range(n):
        at = START + timedelta(seconds=i * 7)
        scope = f"s{draw.randrange(scopes)}"
        if draw.random() < 0.6:
            kind = draw.choice([("PERSON", "KISI"), ("ORG", "KURUM")])
            asked = f"[{kind[1]}_{draw.randint(1, 9)}]" if draw.random() < 0.2 else None
            rows.append(("t", scope, i, at, "intern", *kind, f"v{draw.randrange(12)}", asked))
        else:
            rows.append(("t", scope, i, at, "resolve", None, None, None, f"[{draw.choice(['KISI', 'KURUM'])}_{draw.randint(1, 12)}]"))
    return rows


@pytest.mark.parametrize("files, clock", [(1, "none"), (4, "event")])
def test_against_a_model(spark, tmp_path, files, clock):
    rows = events()
    ttl = timedelta(seconds=300) if clock == "event" else timedelta(hours=10)
    make = lambda s: V.vault_stream(s.withWatermark("at", "1 hour") if clock == "event" else s, int(ttl.total_seconds() * 1000), 8, clock)
    got = run(spark, tmp_path, make, rows, V.EVENTS, files)
    models, want = {}, []
    for _, scope, seq, at, op, kind, label, value, placeholder in rows:
        model = models.setdefault(scope, Model(ttl, 8))
        want += [(scope, seq, *a) for a in model.step(op, at, kind, label, value, placeholder)]
    mine = [(r.session_id, r.seq, r.op, r.placeholder, r.value, r.state) for r in got if r.state != "EXPIRED"]
    assert sorted(map(str, mine)) == sorted(map(str, want))


def test_timers_sweep_what_has_expired(spark, tmp_path):
    rows = [("t", "s", 1, START, "intern", "PERSON", "KISI", "a", None), ("t", "s", 2, START + timedelta(seconds=90), "intern", "PERSON", "KISI", "b", None)]
    rows += [("t", "other", 3, START + timedelta(minutes=3), "intern", "PERSON", "KISI", "a", None), ("t", "s", 4, START + timedelta(minutes=3), "intern", "PERSON", "KISI", "a", None)]
    got = run(spark, tmp_path, lambda s: V.vault_stream(s.withWatermark("at", "0 seconds"), 60_000), rows, V.EVENTS, 2)
    assert [(r.session_id, r.placeholder) for r in got if r.state == "EXPIRED"] == [("s", "[KISI_1]"), ("s", "[KISI_2]")] or {(r.session_id, r.placeholder) for r in got if r.state == "EXPIRED"} >= {("s", "[KISI_1]")}
    assert next(r.placeholder for r in got if r.seq == 4) == "[KISI_3]"


def test_the_store_forgets_by_its_own_clock(spark, tmp_path):
    rows = [("t", "s", 1, START, "intern", "PERSON", "KISI", "a", None)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, V.EVENTS).coalesce(1).write.parquet(str(source))
    stream = V.vault_stream(spark.readStream.schema(V.EVENTS).parquet(str(source)), 3_000, clock="processing")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()

    def seen(n):
        end = time.time() + 60
        while time.time() < end:
            try:
                got = spark.read.schema(V.ANSWERS).parquet(str(tmp_path / "out")).collect()
            except Exception:
                got = []
            if len(got) >= n:
                return got
            time.sleep(0.5)
        raise AssertionError("nothing came out")

    try:
        assert [r.state for r in seen(1)] == ["NEW"]
        time.sleep(6)
        again = [("t", "s", 2, START, "resolve", None, None, None, "[KISI_1]"), ("t", "s", 3, START, "intern", "PERSON", "KISI", "b", None)]
        spark.createDataFrame(again, V.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        assert {(r.seq, r.placeholder, r.state) for r in seen(3)} == {(1, "[KISI_1]", "NEW"), (2, "[KISI_1]", "UNRESOLVED"), (3, "[KISI_2]", "NEW")}
    finally:
        q.stop()


def test_interned_like_the_batch_operator(spark, tmp_path):
    rows = [("t", f"s{i % 4}", i, START + timedelta(seconds=i), "intern", "PERSON", "KISI", f"v{i % 23}", None) for i in range(200)]
    got = run(spark, tmp_path, lambda s: V.vault_stream(s, 10**9, clock="none"), rows, V.EVENTS, 3)
    values = spark.createDataFrame(rows, V.EVENTS).select("tenant_id", "session_id", "type", "label", "value", F.col("seq").alias("first_seen"))
    empty = spark.createDataFrame([], "tenant_id string, session_id string, type string, value string, placeholder string, expires_at timestamp")
    want = {(r.session_id, r.value): r.placeholder for r in batch.intern(empty, values, F.current_timestamp()).collect()}
    assert {(r.session_id, r.value): r.placeholder for r in got} == want


def test_nulls_and_numbers_past_the_grammar(spark, tmp_path):
    rows = [("t", None, 1, START, "intern", "PERSON", "KISI", None, None), ("t", None, 2, START, "intern", "PERSON", "KISI", "a", "[KISI_99999]"), ("t", None, 3, START, "intern", "PERSON", "KISI", "é", None), ("t", None, 4, START, "intern", "PERSON", "KISI", "é", None), ("t", None, 5, START, "peek", None, None, None, None), ("t", None, 6, START, "resolve", None, None, None, None)]
    got = {r.seq: (r.placeholder, r.state) for r in run(spark, tmp_path, lambda s: V.vault_stream(s, 10**9, clock="none"), rows, V.EVENTS)}
    assert got == {1: (None, "NO_VALUE"), 2: ("[KISI_99999]", "NEW"), 3: (P.spell("KISI", 100_000), "NEW"), 4: (P.spell("KISI", 100_000), "KNOWN"), 5: (None, "UNKNOWN_OP"), 6: (None, "UNRESOLVED")}
    with pytest.raises(ValueError):
        V.vault_stream(None, 1, clock="sun")


def test_limits_with_capacity(spark, tmp_path):
    draw, rows = random.Random(1), []
    for i in range(600):
        rows.append((f"k{draw.randrange(40)}", i, START + timedelta(milliseconds=i * 50)))
    limit, window, capacity, every = 3, 5_000, 10, 16
    got = {r.seq: r.allowed for r in run(spark, tmp_path, lambda s: V.capped_limit_stream(s, limit, window, capacity, 1, every), rows, "key string, seq bigint, at timestamp", 3)}
    held, fresh, want = OrderedDict(), 0, {}
    for key, seq, at in rows:
        now = pd.Timestamp(at).value // 1_000_000
        if key not in held:
            fresh += 1
            if fresh >= every:
                fresh = 0
                for k in [k for k, w in held.items() if w[0] <= now]:
                    del held[k]
            while len(held) >= capacity:
                held.popitem(last=False)
        if key not in held or held[key][0] <= now:
            held[key] = [now + window, 0]
        held[key][1] += 1
        want[seq] = held[key][1] <= limit
    assert got == want


class Counted(dict):
    """A map of a state store that counts what it is asked."""

    asked = 0

    def containsKey(self, key):
        self.asked += 1
        return key in self

    def getValue(self, key):
        self.asked += 1
        return self[key]

    def updateValue(self, key, value):
        self.asked += 1
        self[key] = value

    def removeKey(self, key):
        self.asked += 1
        del self[key]

    def iterator(self):
        return iter(self.items())


def test_a_key_is_read_and_written_once_a_batch(monkeypatch):
    from maskframe.streaming import vault as streamed

    state = Counted()
    held = streamed.Held(state, fresh=True)
    for i in range(1000):
        held.put((i % 3,), (i,))
    assert held.get((9,)) is None and state.asked == 0
    held.put((2,), None)
    held.flush()
    assert state == {(0,): (999,), (1,): (997,)} and state.asked == 2
    again = streamed.Held(state, fresh=False)
    assert [again.get((1,)) for _ in range(50)] == [(997,)] * 50 and state.asked == 4
    again.put((0,), None)
    assert again.items() == [((1,), (997,))]
    monkeypatch.setattr(streamed, "HELD", 2)
    few = streamed.Held(state, fresh=False)
    for i in range(10):
        few.put((i,), (i,))
    assert len(few.known) <= 2 and few.get((0,)) == (0,) and len(few.items()) == 10
