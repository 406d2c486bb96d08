"""Stored tables: replayed batches, racing writers, buckets that are read."""

import threading

import pytest
from pyspark.sql import functions as F

from maskframe.operators import vault as V
from maskframe.sources import tables as S

LATER = "2100-01-01"


def stamp(t):
    return F.lit(t).cast("timestamp")


def test_latest_row_of_each_key(spark, tmp_path):
    t = S.KeyedTable(spark, str(tmp_path / "t"), "k int, v string", ["k"], buckets=4, deltas=2)
    put = lambda rows, n, who="w": t.commit(lambda _: spark.createDataFrame(rows, "k int, v string"), who, n)
    assert put([(1, "a"), (2, "b"), (None, "n")], 0) and put([(2, "c"), (3, "d")], 1)
    assert not put([(1, "again")], 1) and not put([(1, "older")], 0)
    assert put([(9, "x")], 0, "other")
    assert sorted(map(tuple, t.snapshot().rows().collect()), key=str) == sorted([(1, "a"), (2, "c"), (3, "d"), (9, "x"), (None, "n")], key=str)
    gone = spark.createDataFrame([(1, None, True), (7, None, True)], f"k int, v string, {S.DELETED} boolean")
    for n in range(2, 8):
        assert put([(2, f"v{n}")], n)
    t.commit(lambda _: gone, "w", 8)
    assert {r.k: r.v for r in t.snapshot().rows().collect()} == {2: "v7", 3: "d", 9: "x", None: "n"}
    assert all(len(d) <= 2 for d in t.snapshot().manifest["buckets"].values())
    wanted = spark.createDataFrame([(2,)], "k int")
    looked = t.snapshot().lookup(wanted)
    assert [tuple(r) for r in looked.collect()] == [(2, "v7")]
    assert len({f.split(S.BUCKET + "=")[1].split("/")[0] for f in looked.inputFiles()}) == 1
    again = S.KeyedTable(spark, str(tmp_path / "t"), "k int, v string", ["k"], buckets=4)
    assert again.snapshot().rows().count() == 4
    with pytest.raises(ValueError):
        S.KeyedTable(spark, str(tmp_path / "t"), "k int, v string", ["k"], buckets=5)


def test_names_are_claimed_once(spark, tmp_path):
    for root in (str(tmp_path), f"file://{tmp_path}"):
        files = S.Files(spark, root)
        files.create("log/x.json", "1") if not files.names("log") else None
        with pytest.raises(S.Conflict):
            files.create("log/x.json", "2")
        assert files.read("log/x.json") == "1" and files.names("log") == ["x.json"]
    other = S.Files(spark, str(tmp_path))
    other.root = "viewed:" + other.root  # takes the way of other file systems
    other.path = lambda name: files.path(name)
    with pytest.raises(S.Conflict):
        other.create("log/x.json", "3")
    other.create("log/y.json", "4")
    assert sorted(files.names("log")) == ["x.json", "y.json"] and files.read("log/y.json") == "4"


def race(*works):
    errors = []

    def run(work):
        try:
            work()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=run, args=(w,)) for w in works]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors, errors


def values(spark, rows):
    return spark.createDataFrame([("t", "s", "PERSON", "KISI", v, i) for i, v in enumerate(rows)], "tenant_id string, session_id string, type string, label string, value string, first_seen int")


def test_vault_of_two_writers(spark, tmp_path):
    vault = S.StoredVault(spark, str(tmp_path / "v"), b"0123456789abcdef", "secret", 4)
    a, b = values(spark, ["Ali", "Veli", "Ayşe"]), values(spark, ["Veli", "Can"])
    race(lambda: vault.intern(a, stamp(LATER), stamp("2030-01-01"), "a", 0), lambda: vault.intern(b, stamp(LATER), stamp("2030-01-01"), "b", 0))
    assert not vault.intern(a, stamp(LATER), stamp("2030-01-01"), "a", 0)
    asked = spark.createDataFrame([("t", "s", f"[KISI_{i}]") for i in range(1, 6)] + [("t", "x", "[KISI_1]")], "tenant_id string, session_id string, placeholder string")
    got = {(r.session_id, r.placeholder): r.value for r in vault.resolve(asked, stamp("2030-01-01")).collect()}
    assert sorted(v for v in got.values() if v) == ["Ali", "Ayşe", "Can", "Veli"] and got["s", "[KISI_5]"] is None and got["x", "[KISI_1]"] is None
    stored = vault.table.snapshot().rows()
    assert b"Veli" not in b"".join(bytes(r.sealed) for r in stored.collect())
    digests = stored.select(*V.SCOPE, F.col("entity_type").alias("type"), "value_hmac")
    assert vault.by_digest(digests).count() == 4
    assert vault.sweep(stamp("2100-01-02"), "sweeper", 0) and vault.table.snapshot().rows().count() == 0


def test_log_of_two_writers(spark, tmp_path):
    log = S.StoredLog(spark, str(tmp_path / "l"), "key", 4)
    rows = lambda who, n: spark.createDataFrame([("one", f"{who}{i}", i) for i in range(n)] + [("two", None, 9)], "log string, payload string, at int")
    race(*[lambda w=w: log.append(rows(w, 20), "at", w, 0) for w in "ab"])
    assert not log.append(rows("a", 20), "at", "a", 0)
    assert log.append(rows("c", 5), "at", "a", 1)
    got = sorted((r.log, r.seq, r.payload) for r in log.records().collect() if r.log == "one")
    assert [s for _, s, _ in got] == list(range(1, 46)) and len({p for *_, p in got}) == 45
    assert {(r.log, r.ok, r.verified) for r in log.verify().collect()} == {("one", True, 45), ("two", True, 3)}
    one = spark.createDataFrame([("one",)], "log string")
    assert sorted(r.seq for r in log.records(one, 3, 6).collect()) == [3, 4, 5, 6]
    assert "GreaterThanOrEqual(seq,3)" in log.records(one, 3, 6)._jdf.queryExecution().executedPlan().toString()
    heads = S.StoredHeads(spark, str(tmp_path / "h"), "key")
    assert heads.advance(log.heads(), "h", 0) and not heads.advance(log.heads(), "h", 0)
    assert {(r.log, r.seq) for r in heads.heads().collect()} == {("one", 45), ("two", 3)}
    back = spark.createDataFrame([("one", 7, "x")], "log string, seq long, hash string")
    assert heads.advance(back, "h", 1) and {r.log: r.seq for r in heads.heads().collect()}["one"] == 45
    with pytest.raises(ValueError):
        heads.advance(spark.createDataFrame([("one", 45, "x")], "log string, seq long, hash string"), "h", 2)


def test_streams_commit_each_batch_once(spark, tmp_path):
    log = S.StoredLog(spark, str(tmp_path / "l"), "key", 2)
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", f"p{i}", i) for i in range(10)], "log string, payload string, at int").repartition(3).write.parquet(source)
    sink = lambda df, n: log.append(df.repartition(2), "at", "stream", n)
    calls = []

    def twice(df, n):
        held = df.persist()
        calls.append((sink(held, n), sink(held, n)))
        held.unpersist()

    stream = spark.readStream.schema("log string, payload string, at int").option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(calls) > 1 and set(calls) == {(True, False)}
    assert log.records().count() == 10 and log.verify().first().ok
    t = S.KeyedTable(spark, str(tmp_path / "k"), "log string, n long", ["log"], buckets=2)
    add = t.sink("s", lambda df, at: df.groupBy("log").count().withColumnRenamed("count", "n").unionByName(at.rows()).groupBy("log").agg(F.sum("n").alias("n")))
    part = spark.createDataFrame([("a",), ("a",), ("b",)], "log string")
    [add(part, n) for n in (0, 0, 1)]
    assert {r.log: r.n for r in t.snapshot().rows().collect()} == {"a": 4, "b": 2}
