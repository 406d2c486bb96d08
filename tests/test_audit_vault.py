import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from maskframe.operators import audit, vault
from maskframe.sources import readers

KEY = "test-key"


def chain(spark, n=6):
    rows = [("log", i, f"p{i}") for i in range(1, n + 1)]
    return audit.append(spark.createDataFrame(rows, "log string, seq long, payload string"), KEY, "log")


def check(rows, **kw):
    return audit.verify(rows, audit.keyed_hash(KEY)(F.concat("payload", "prev_hash")), **kw).first()


def test_chain_is_linked_in_order(spark):
    rows = sorted(chain(spark).collect(), key=lambda r: r.seq)
    last = audit.GENESIS
    for r in rows:
        assert r.prev_hash == last
        last = hmac.new(KEY.encode(), (r.payload + last).encode(), hashlib.sha256).hexdigest()
        assert r.hash == last


def test_tampering_and_gaps_are_found(spark):
    rows = chain(spark)
    assert tuple(check(rows)) == (True, 6, None, False)
    changed = rows.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload")))
    assert tuple(check(changed)) == (False, 2, 3, False)
    assert tuple(check(rows.filter("seq <> 4"))) == (False, 3, 5, False)
    assert tuple(check(rows.filter("seq > 1"))) == (False, 0, 2, False)
    assert tuple(check(changed, first=4)) == (False, 0, 3, True) and tuple(check(changed, last=2)) == (False, 2, 3, True)
    assert tuple(check(rows, first=2, last=4)) == (True, 3, None, False)
    assert tuple(check(rows.unionByName(rows.filter("seq = 2")))) == (False, 1, 2, False)
    assert tuple(check(rows.limit(0))) == (True, 0, None, False)


def test_a_foreign_genesis_is_found(spark):
    rows = spark.createDataFrame([(1, "a")], "seq long, payload string").withColumn("prev_hash", F.sha2(F.lit("elsewhere"), 256))
    rows = rows.withColumn("hash", audit.keyed_hash(KEY)(F.concat("payload", "prev_hash")))
    assert tuple(check(rows)) == (False, 0, 1, False)
    assert check(rows, genesis=hashlib.sha256(b"elsewhere").hexdigest()).ok


def test_checkpoints_catch_a_cut_tail(spark, tmp_path):
    rows = chain(spark)
    last = rows.orderBy(F.desc("seq")).first()
    line = {"v": 1, "seq": last.seq, "hash": last.hash}
    line["mac"] = hmac.new(b"m", f"{audit.CHECKPOINT}\0{last.seq}\0{last.hash}".encode(), hashlib.sha256).hexdigest()
    path = tmp_path / "c.ndjson"
    path.write_text(json.dumps(line) + "\n" + json.dumps({**line, "seq": 99}) + "\n")
    points = readers.read_checkpoints(spark, str(path), "m")
    assert points.count() == 1 and readers.head(points).first().seq == last.seq
    assert audit.against_checkpoints(rows, points).count() == 0
    assert audit.against_checkpoints(rows.filter("seq < 6"), points).count() == 1
    assert check(rows, checkpoints=points).ok
    assert tuple(check(rows.filter("seq < 5"), checkpoints=points)) == (False, 4, 5, False)
    assert tuple(check(rows.limit(0), checkpoints=points)) == (False, 0, 1, False)
    early = rows.filter("seq = 4").select("seq", "hash")
    assert tuple(check(rows, checkpoints=early)) == (False, 6, 5, False)
    assert check(rows, checkpoints=early.withColumn("hash", F.lit("x"))).first_broken_seq == 5


def test_logs_go_on_where_they_ended(spark):
    rows = chain(spark)
    more = spark.createDataFrame([("log", 20, "p8"), ("log", 10, "p7"), ("new", 1, "q1")], "log string, seq long, payload string")
    both = rows.unionByName(audit.append(more, KEY, "log", stored=rows))
    got = {r.log: tuple(r)[1:] for r in audit.verify(both, audit.keyed_hash(KEY)(F.concat("payload", "prev_hash")), log="log").collect()}
    assert got == {"log": (True, 8, None, False), "new": (True, 1, None, False)}
    assert [r.payload for r in both.filter("log = 'log'").orderBy("seq").collect()] == [f"p{i}" for i in range(1, 9)]


def test_heads_only_go_forward(spark):
    heads = spark.createDataFrame([("a", 5, "h5"), ("b", 5, "h5"), ("c", 5, "h5")], "log string, seq long, hash string")
    wanted = spark.createDataFrame([("a", 7, "h7"), ("b", 5, "other"), ("c", 4, "h4"), ("d", 1, "h1")], "log string, seq long, hash string")
    rows = {r.log: r for r in audit.advance(heads, wanted, "k", "log").collect()}
    assert {k: r.error_code for k, r in rows.items()} == {"a": None, "b": "CONFLICT", "d": None}
    assert rows["a"].mac == hmac.new(b"k", f"{audit.CHECKPOINT}\0{7}\0h7".encode(), hashlib.sha256).hexdigest()


def test_canonical_json_sorts_every_level(spark):
    df = spark.sql("select named_struct('z', 1, 'a', array(named_struct('y', null, 'b', 'ü'))) s, map('k', 2, 'c', 1) m, 'x' a")
    assert df.select(audit.canonical(df, "s", "m", "a")).first()[0] == '{"a":"x","m":{"c":1,"k":2},"s":{"a":[{"b":"ü","y":null}],"z":1}}'
    half = spark.sql("select 1.5D v")
    assert half.select(audit.canonical(half, "v")).first()[0] == '{"v":1.5}'


def test_anchors_and_fingerprints(spark):
    row = audit.anchors(spark.sql("select date'2024-01-02' day")).first()
    assert row.kind == "ANCHOR" and row.request_sha256 == hashlib.sha256(b"2024-01-02").hexdigest() and row.entities == []
    got = spark.sql("select 'v' v").select(audit.fingerprint(F.col("v"), "k")).first()[0]
    assert got == hmac.new(b"k", f"{audit.FINGERPRINT}\0v".encode(), hashlib.sha256).hexdigest()


def log(spark):
    rows = [
        (1, "2024-01-01 00:00:00", "MASK_APPLIED", [("EMAIL", "mask", 2), ("ORG", "allow", 5)]),
        (2, "2024-01-01 23:59:59.999", "VAULT_RESOLVE", [("EMAIL", "mask", 1)]),
        (3, "2024-01-02 00:00:00", "POLICY_CHANGED", []),
        (4, "2024-01-03 00:00:00", "REQUEST_BLOCKED", None),
    ]
    return spark.createDataFrame(rows, f"seq long, ts string, kind string, entities array<{audit.ENTITY}>").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_reports(spark):
    rows = log(spark)
    assert audit.period_report(rows, "2024-01-01", "2024-01-01").first().asDict() == {"events": 2, "masked": 3, "masked_strict": 2, "blocked": 0, "vault_resolves": 1, "policy_changes": 0}
    assert audit.period_report(rows, "2030-01-01", "2030-01-01").first().events == 0
    assert tuple(audit.kind_counts(rows).first()) == (1, 1, 4)
    assert [tuple(r) for r in audit.ranked_entities(rows).collect()] == [("ORG", 5), ("EMAIL", 3)]
    assert [r.seq for r in audit.page(rows, 2, 2).collect()] == [2, 1] and audit.latest(rows).first().seq == 4
    with pytest.raises(ValueError):
        audit.page(rows, 0)


def test_export_reads_back(spark, tmp_path):
    rows = log(spark).select("seq", "kind", "entities")
    audit.export(rows, str(tmp_path / "x"), 2, 3)
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "x")).collect())
    assert sorted(json.loads(x)["seq"] for x in lines) == [2, 3] and lines[0].startswith('{"entities"')
    assert readers.read_audit(spark, str(tmp_path / "x")).count() == 2


def test_events_from_spans(spark):
    spans = spark.createDataFrame([("r", "EMAIL"), ("r", "EMAIL"), ("r", "ORG")], "req string, type string")
    acted = spark.createDataFrame([("EMAIL", "mask"), ("ORG", "allow")], "type string, action string")
    row = audit.from_events(spans, "req", acted).first()
    assert [tuple(e) for e in row.entities] == [("EMAIL", "mask", 2), ("ORG", "allow", 1)] and len(row.request_sha256) == 64


VAULT = "tenant_id string, session_id string, type string, value string, placeholder string, expires_at timestamp"


def test_intern_is_stable_and_scoped(spark):
    old = spark.createDataFrame([("t", "s", "PERSON", "A", "[KISI_4]", None)], VAULT)
    values = spark.createDataFrame([("t", "s", "PERSON", "KISI", "A", 1), ("t", "s", "PERSON", "KISI", "B", 3), ("t", "s", "PERSON", "KISI", "C", 2), ("u", "s", "PERSON", "KISI", "A", 1)], "tenant_id string, session_id string, type string, label string, value string, first_seen int")
    got = {(r.tenant_id, r.value, r.placeholder) for r in vault.intern(old, values, F.lit("2030-01-01").cast("timestamp")).collect()}
    assert got == {("t", "C", "[KISI_5]"), ("t", "B", "[KISI_6]"), ("u", "A", "[KISI_1]")}


def test_intern_composes_and_forgets(spark):
    old = spark.sql("select 't' tenant_id, 's' session_id, 'PERSON' type, 'Çağ' value, '[KISI_4]' placeholder, timestamp'2024-01-02' expires_at")
    values = spark.createDataFrame([("t", "s", "PERSON", "KISI", "C\u0327ag\u0306", 1)], "tenant_id string, session_id string, type string, label string, value string, first_seen int")
    later = F.lit("2030-01-01").cast("timestamp")
    assert vault.intern(old, values, later).count() == 0
    assert vault.intern(old, values, later, now=F.lit("2024-01-01").cast("timestamp")).count() == 0
    assert [r.placeholder for r in vault.intern(old, values, later, now=later).collect()] == ["[KISI_5]"]


def test_allocation_probes_past_what_is_taken(spark):
    scope = "tenant_id string, session_id string, placeholder string"
    taken = spark.createDataFrame([("t", "s", "[KISI_1]"), ("t", "s", "[KISI_3]"), ("u", "s", "[TEL_1]")], scope)
    wanted = spark.createDataFrame([("t", "s", "[KISI_1]", 1), ("t", "s", "[KISI_2]", 2), ("t", "s", "[KISI_2]", 3), ("t", "s", "[TEL_1]", 4), ("t", "s", "[KISI_1]#0123456789abcdef", 5)], scope + ", n int")
    got = [r.given for r in vault.allocate(taken, wanted, "n").orderBy("n").collect()]
    assert got == ["[KISI_4]", "[KISI_2]", "[KISI_5]", "[TEL_1]", "[KISI_1]#0123456789abcdef"]


def test_touch_sessions_and_capacity(spark):
    rows = spark.sql("select 't' tenant_id, 's' session_id, 'PERSON' type, v value, p placeholder, cast(u as timestamp) used_at, cast(e as timestamp) expires_at from values ('A','[KISI_1]','2024-01-01','2024-01-09'), ('B','[KISI_2]','2024-01-01','2024-01-02') as x(v, p, u, e)")
    now = F.lit("2024-01-05").cast("timestamp")
    got = {r.placeholder: str(r.used_at)[:10] for r in vault.touch(rows, rows, now).collect()}
    assert got == {"[KISI_1]": "2024-01-05", "[KISI_2]": "2024-01-01"}
    assert vault.sessions(rows, now).first().placeholders == 1
    digest = hmac.new(b"k", "maskframe-vault-value-v1\0PERSON\0A".encode(), hashlib.sha256).hexdigest()
    wanted = spark.createDataFrame([("t", "s", "PERSON", digest)], "tenant_id string, session_id string, type string, value_hmac string")
    assert vault.by_digest(rows, wanted, "k").first().placeholder == "[KISI_1]"
    windows = spark.sql("select k key, cast(o as timestamp) opened_at, cast(e as timestamp) ends_at from values ('a','2024-01-01','2024-01-09'), ('b','2024-01-02','2024-01-09'), ('c','2024-01-03','2024-01-04'), ('d','2024-01-04','2024-01-09') as x(k, o, e)")
    assert {r.key for r in vault.within_capacity(windows, now, 2).collect()} == {"b", "d"}


def test_resolve_respects_expiry_and_tenant(spark):
    rows = spark.sql("select 't' tenant_id, 's' session_id, 'PERSON' type, 'A' value, '[KISI_1]' placeholder, timestamp'2024-01-02' expires_at")
    wanted = spark.createDataFrame([("t", "s", "[KISI_1]"), ("u", "s", "[KISI_1]")], "tenant_id string, session_id string, placeholder string")
    at = lambda day: {r.tenant_id: r.value for r in vault.resolve(rows, wanted, F.lit(day).cast("timestamp")).collect()}
    assert at("2024-01-01") == {"t": "A", "u": None} and at("2024-01-02") == {"t": None, "u": None}


def test_rate_limit_windows_open_with_a_hit(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([0, 10, 50, 59, 60, 61, 200])], "k string, id int, s int")
    hits = rows.withColumn("at", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(secs="s")).cast("timestamp_ntz"))
    got = [r.allowed for r in vault.rate_limited(hits, "k", "at", "id", 2, "60s").orderBy("id").collect()]
    assert got == [True, True, False, False, True, True, True]


def test_license_states(spark):
    df = spark.createDataFrame([("2024-06-01",), ("2024-02-15",), ("2024-02-01",), ("2024-01-25",), ("2023-12-01",), (None,)], "e string").withColumn("e", F.col("e").cast("timestamp"))
    state = vault.license_state(F.col("e"), F.lit(14), F.lit("2024-02-01").cast("timestamp"))
    assert [r[0] for r in df.select(state).collect()] == ["valid", "expiring", "expiring", "grace", "frozen", "open"]


def test_sealed_values(spark):
    key, iv = F.unhex(F.lit("00" * 16)), F.unhex(F.lit("01" * 12))
    df = spark.createDataFrame([("Ayşe",)], "v string").withColumn("s", vault.encrypt(F.col("v"), key, iv, F.lit("a")))
    assert tuple(df.select(vault.decrypt(F.col("s"), key, F.lit("a")), vault.decrypt(F.col("s"), key, F.lit("b")), F.octet_length("s")).first()) == ("Ayşe", None, 12 + 5 + 16)


def test_null_payloads_and_plans_with_checkpoints(spark):
    rows = audit.append(spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, ""), ("c", 1, "y"), ("c", 2, None)], "log string, seq long, payload string"), KEY, "log")
    expected = audit.record_hash(F.col("payload"), KEY)
    assert {r.log: r.ok for r in audit.verify(rows, expected, log="log").collect()} == {"a": True, "b": True, "c": True}
    blanked = rows.withColumn("payload", F.coalesce("payload", F.lit("")))
    assert {r.log: r.first_broken_seq for r in audit.verify(blanked, expected, log="log").collect()} == {"a": 1, "b": None, "c": 2}
    heads = {r.log: (r.seq, r.hash) for r in sorted(rows.collect(), key=lambda r: r.seq)}
    points = spark.createDataFrame([("a", *heads["a"]), ("b", heads["b"][0], "other"), ("c", 1, "old"), ("c", *heads["c"]), ("d", 4, "gone")], "log string, seq long, hash string")
    state = audit.verify(rows, expected, log="log", checkpoints=points)
    assert {r.log: (r.ok, r.first_broken_seq) for r in state.collect()} == {"a": (True, None), "b": (False, 2), "c": (True, None), "d": (False, 1)}
    twice = points.unionByName(spark.createDataFrame([("a", 2, "another")], points.schema))
    assert {r.log: r.ok for r in audit.verify(rows, expected, log="log", checkpoints=twice).collect()}["a"] is False
    one = audit.verify(rows.filter("log = 'a'"), expected, checkpoints=points.filter("log = 'a'").drop("log"))
    assert one.first().ok
    for df in (state, one):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Join" not in plan


def test_appends_stay_in_order_where_a_join_becomes_a_broadcast(spark):
    """The plan begins with a sorted join of records and heads, which the first stages' sizes turn into a broadcast."""
    how = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in how.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 400, 1, 4).select((F.col("id") % 7).cast("string").alias("log"), F.col("id").alias("seq"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("payload"))
        held = spark.createDataFrame([(str(i), 5, "h") for i in range(7)], "log string, seq long, hash string")
        got = audit.append(rows, KEY, "log", stored=held).collect()
    finally:
        for k in how:
            spark.conf.unset(k)
    assert len(got) == 400
    for name in "0123456":
        own = sorted((r for r in got if r.log == name), key=lambda r: int(r.payload[1:]))
        assert [r.seq for r in own] == list(range(6, 6 + len(own))) and [r.prev_hash for r in own] == ["h", *[r.hash for r in own[:-1]]]
