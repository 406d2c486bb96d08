"""Queries over the audit log, the vault and corpus tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from maskframe.operators import audit, corpus, select, vault
from maskframe.plans.tables import AUDIT_SQL, audit_log, spread, table

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


@query(f"WITH {AUDIT_SQL} SELECT count(*) FILTER (WHERE kind = 'MASK_APPLIED') AS masked, count(*) FILTER (WHERE kind = 'REQUEST_BLOCKED') AS blocked, count(*) AS events FROM log")
def audit_kind_counts(spark, sf_dir):
    return audit.kind_counts(audit_log(spark, sf_dir))


@query(f"WITH {AUDIT_SQL} SELECT type, CAST(sum(k) AS BIGINT) AS total FROM log GROUP BY type")
def audit_entity_sum(spark, sf_dir):
    return audit.entity_totals(audit_log(spark, sf_dir))


@query(f"WITH {AUDIT_SQL} SELECT type, CAST(sum(k) AS BIGINT) AS total FROM log GROUP BY type ORDER BY total DESC, type")
def audit_entity_rank(spark, sf_dir):
    return audit.ranked_entities(audit_log(spark, sf_dir))


@query(f"WITH {AUDIT_SQL} SELECT seq, kind, actor FROM log ORDER BY seq DESC LIMIT 25 OFFSET 50")
def audit_page_desc(spark, sf_dir):
    return audit.page(audit_log(spark, sf_dir).select("seq", "kind", "actor"), 3, 25)


@query(f"WITH {AUDIT_SQL} SELECT CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS pages FROM log")
def audit_page_count(spark, sf_dir):
    return audit_log(spark, sf_dir).agg(F.count("*").alias("n")).select(audit.page_count(F.col("n")).cast("long").alias("pages"))


@query(f"WITH {AUDIT_SQL} SELECT seq, ts, kind, actor FROM log ORDER BY seq DESC LIMIT 1")
def audit_latest(spark, sf_dir):
    return audit.latest(audit_log(spark, sf_dir).select("seq", "ts", "kind", "actor"))


@query(f"WITH {AUDIT_SQL} SELECT seq, kind, actor, k FROM log WHERE seq BETWEEN 101 AND 400")
def audit_range_export(spark, sf_dir):
    return audit.in_range(audit_log(spark, sf_dir), 101, 400).select("seq", "kind", "actor", "k")


@query(f"""WITH {AUDIT_SQL}, p AS (SELECT * FROM log WHERE ts >= '2024-01-05 00:00:00' AND ts <= '2024-01-14 23:59:59.999')
SELECT count(*) AS events, CAST(coalesce(sum(k), 0) AS BIGINT) AS masked, CAST(coalesce(sum(k) FILTER (WHERE kind = 'MASK_APPLIED'), 0) AS BIGINT) AS masked_strict,
  count(*) FILTER (WHERE kind = 'REQUEST_BLOCKED') AS blocked, count(*) FILTER (WHERE kind = 'VAULT_RESOLVE') AS vault_resolves, count(*) FILTER (WHERE kind = 'POLICY_CHANGED') AS policy_changes FROM p""")
def audit_period_report(spark, sf_dir):
    return audit.period_report(audit_log(spark, sf_dir), "2024-01-05", "2024-01-14")


def _logs(spark, sf_dir):
    """A log for each actor, whose records link to their predecessors' digests; what was done to it follows from its name.

    Of five actors one has another genesis, one lost its last two records, one has its third record
    changed, one lost its second, and one is whole.
    """
    order = Window.partitionBy("actor").orderBy("seq")
    rows = audit_log(spark, sf_dir).select("actor", "seq", "kind", "k").withColumn("n", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("payload", F.concat_ws("|", "actor", F.col("n").cast("string"), "kind", F.col("k").cast("string")))
    last, past = F.count("*").over(Window.partitionBy("actor")), F.lag("payload").over(order)
    rows = rows.select("actor", F.col("n").alias("seq"), "payload", past.alias("past"), last.alias("top"))
    kind = F.col("actor").cast("int") % 5
    start = F.when(kind == 1, F.sha2(F.lit("elsewhere"), 256)).otherwise(F.lit(audit.GENESIS))
    own = rows.select("actor", "seq", "payload", "top", F.sha2("payload", 256).alias("hash"), F.when(F.col("seq") == 1, start).otherwise(F.sha2("past", 256)).alias("prev_hash"))
    heads = own.filter("seq = top").select("actor", "seq", "hash")
    lost = ((kind == 2) & (F.col("seq") > F.col("top") - 2)) | ((kind == 4) & (F.col("seq") == 2))
    stored = own.filter(~lost).drop("top")
    return stored.withColumn("payload", F.when((kind == 3) & (F.col("seq") == 3), F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))), heads


_LOGS = f"""WITH {AUDIT_SQL}, n AS (SELECT actor, count(*) AS n, CAST(actor AS INTEGER) % 5 AS kind FROM log GROUP BY actor),
b AS (SELECT actor, n, CAST(CASE WHEN kind = 1 THEN 1 WHEN kind = 2 THEN greatest(n - 1, 1) WHEN kind = 3 AND n >= 3 THEN 3 WHEN kind = 4 AND n >= 3 THEN 3 WHEN kind = 4 AND n = 2 THEN 2 END AS BIGINT) AS broken FROM n)"""


@query(f"""{_LOGS} SELECT actor, broken IS NULL AS ok, CAST(greatest(0, least(CASE WHEN CAST(actor AS INTEGER) % 5 = 4 THEN 1 ELSE coalesce(broken - 1, n) END, 20) - 1) AS BIGINT) AS verified, broken AS first_broken_seq, coalesce(broken < 2 OR broken > 20, false) AS out_of_range
FROM b""")
def chain_sha_verify(spark, sf_dir):
    """Records 2 to 20 of every actor's log against its checkpoint: a foreign genesis, cut tails, changed and missing records."""
    stored, heads = _logs(spark, sf_dir)
    return audit.verify(stored, F.sha2("payload", 256), log="actor", checkpoints=heads, first=2, last=20)


@query(f"""{_LOGS} SELECT actor, CASE WHEN CAST(actor AS INTEGER) % 5 = 2 OR (CAST(actor AS INTEGER) % 5 = 4 AND n = 2) THEN 'LOST_HEAD' WHEN broken IS NOT NULL THEN 'BROKEN'
  WHEN CAST(actor AS INTEGER) % 10 = 5 THEN CASE WHEN n > 2 THEN 'ADVANCE' WHEN n = 2 THEN 'CURRENT' ELSE 'UNANCHORED' END WHEN CAST(actor AS INTEGER) % 20 = 0 THEN 'UNANCHORED' ELSE 'CURRENT' END AS state
FROM b""")
def chain_reconcile(spark, sf_dir):
    """What each log needs before it goes on; some whole logs have no head yet, or an older one."""
    stored, heads = _logs(spark, sf_dir)
    number = F.col("actor").cast("int")
    older = stored.filter((number % 10 == 5) & (F.col("seq") == 2)).select("actor", "seq", "hash")
    known = heads.filter((number % 5 != 0) | (number % 20 == 10)).unionByName(older)
    return audit.reconcile(stored, F.sha2("payload", 256), known, "actor").select("actor", "state")


@query(f"""WITH {AUDIT_SQL}, n AS (SELECT actor, count(*) AS n FROM log GROUP BY actor)
SELECT actor, actor <> '7' AS ok, CAST(CASE WHEN actor = '7' THEN n // 2 ELSE n END AS BIGINT) AS verified, CAST(CASE WHEN actor = '7' THEN n // 2 + 1 END AS BIGINT) AS first_broken_seq, false AS out_of_range FROM n""")
def chain_hmac_verify(spark, sf_dir):
    """Each actor's log, linked under a key in two goes: the first half, then what is appended to it; one is changed in between."""
    key = "not-a-secret"
    rows = audit_log(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("actor").orderBy("seq")).cast("long")
    size = rows.groupBy("actor").agg(F.floor(F.count("*") / 2).alias("half"))
    numbered = rows.select("actor", n.alias("n"), F.concat_ws("|", "kind", F.col("k").cast("string")).alias("payload")).join(size, "actor").withColumnRenamed("n", "seq")
    first = audit.append(numbered.filter("seq <= half").select("actor", "seq", "payload"), key, "actor")
    more = audit.append(numbered.filter("seq > half").select("actor", "seq", "payload"), key, "actor", stored=first.withColumn("hash", F.when(F.col("actor") == "7", F.reverse("hash")).otherwise(F.col("hash"))))
    both = first.unionByName(more)
    return audit.verify(both, audit.keyed_hash(key)(F.concat("payload", "prev_hash")), log="actor")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def distinct_on_first(spark, sf_dir):
    return vault.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-01-01'")
def session_user_join(spark, sf_dir):
    live = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS") > F.lit("1998-01-01").cast("timestamp_ntz"))
    return live.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_name")


@query("""WITH RECURSIVE hits AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), walk AS (
  SELECT user_id, event_id, n, ts + INTERVAL 36 HOUR AS ends, 1 AS c FROM hits WHERE n = 1
  UNION ALL
  SELECT h.user_id, h.event_id, h.n, CASE WHEN w.ends <= h.ts THEN h.ts + INTERVAL 36 HOUR ELSE w.ends END, CASE WHEN w.ends <= h.ts THEN 1 ELSE w.c + 1 END FROM walk w JOIN hits h ON h.user_id = w.user_id AND h.n = w.n + 1
) SELECT user_id, event_id, c <= 2 AS allowed FROM walk""")
def rate_limit_fixed(spark, sf_dir):
    return vault.rate_limited(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 2, "36h").select("user_id", "event_id", "allowed")


@query("SELECT count(*) FILTER (WHERE ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20') AS live, count(*) FILTER (WHERE ts + INTERVAL 10 DAY <= TIMESTAMP '2024-01-20') AS expired FROM events")
def ttl_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    total = rows.agg(F.count("*").alias("n"))
    return vault.sweep(rows, now).agg(F.count("*").alias("live")).join(F.broadcast(total)).select("live", (F.col("n") - F.col("live")).alias("expired"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 40")
def lru_evict(spark, sf_dir):
    return vault.evicted(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 40).select("user_id", "event_id")


@query("SELECT o_custkey AS scope, CASE o_orderstatus WHEN 'F' THEN 'KISI' WHEN 'O' THEN 'IBAN' ELSE 'SIR' END AS label, max(o_orderkey % 9999 + 1) AS last_n FROM orders GROUP BY ALL")
def counter_upsert_max(spark, sf_dir):
    label = F.when(F.col("o_orderstatus") == "F", "KISI").when(F.col("o_orderstatus") == "O", "IBAN").otherwise("SIR")
    placeholder = F.concat(F.lit("["), label, F.lit("_"), (F.col("o_orderkey") % 9999 + 1).cast("string"), F.lit("]"))
    return vault.counters(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), placeholder.alias("placeholder")), ["scope"])


@query("""WITH v AS (SELECT o_custkey, o_orderstatus, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY ALL),
n AS (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 99998 WHEN 1 THEN 4 ELSE 0 END + row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY f, o_orderpriority) AS n FROM v)
SELECT CAST(o_custkey AS VARCHAR) AS tenant_id, o_orderpriority AS value, o_orderstatus AS session_id,
  '[KURUM_' || ((n - 1) % 99999 + 1) || ']' || CASE WHEN n > 99999 THEN '#00000000' || format('{:08x}', (n - 1) // 99999) ELSE '' END AS placeholder FROM n""")
def vault_intern(spark, sf_dir):
    """New values of sessions of which some have given out number 99,998 already, and some hold an expired row of the same value."""
    values = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("tenant_id"), F.col("o_orderstatus").alias("session_id"), F.lit("ORG").alias("type"), F.lit("KURUM").alias("label"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("first_seen"))
    kind = F.col("tenant_id").cast("long") % 3
    held = values.select("tenant_id", "session_id", "type", F.when(kind == 0, "held").otherwise(F.col("value")).alias("value"), F.when(kind == 0, "[KURUM_99998]").otherwise("[KURUM_4]").alias("placeholder"), F.when(kind == 0, "2100-01-01").otherwise("2000-01-01").cast("timestamp").alias("expires_at")).filter(kind < 2).distinct()
    return vault.intern(held, values, F.current_timestamp(), F.lit("2030-01-01").cast("timestamp")).select("tenant_id", "session_id", "value", "placeholder")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS unreadable, count(*) AS refused FROM customer")
def vault_seal(spark, sf_dir):
    """Values sealed under AES-GCM: read back in their own scope, refused in another."""
    key, iv = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f")), F.substring(F.unhex(F.sha2("c_name", 256)), 1, 12)
    aad = F.concat(F.lit("tenant|"), F.col("c_custkey").cast("string"))
    sealed = table(spark, sf_dir, "customer").withColumn("sealed", vault.encrypt(F.col("c_name"), key, iv, aad))
    opened = vault.decrypt(F.col("sealed"), key, aad)
    return sealed.agg(F.count("*").alias("n"), F.count_if(~opened.eqNullSafe(F.col("c_name"))).alias("unreadable"), F.count_if(vault.decrypt(F.col("sealed"), key, F.concat(aad, F.lit("x"))).isNull()).alias("refused"))


@query("""SELECT o_orderkey, CASE WHEN TIMESTAMP '1998-06-01' <= e THEN CASE WHEN e - TIMESTAMP '1998-06-01' < INTERVAL 30 DAY THEN 'expiring' ELSE 'valid' END
  WHEN TIMESTAMP '1998-06-01' <= e + INTERVAL 14 DAY THEN 'grace' ELSE 'frozen' END AS state FROM (SELECT o_orderkey, o_orderdate + INTERVAL 60 DAY AS e FROM orders)""")
def license_state(spark, sf_dir):
    expires = (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", vault.license_state(expires, F.lit(14), F.lit("1998-06-01").cast("timestamp")).alias("state"))


@query("SELECT sha256(text) AS fingerprint, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def fingerprint_dups(spark, sf_dir):
    return corpus.duplicates(table(spark, sf_dir, "documents").filter("text is not null"), F.sha2("text", 256))


@query("SELECT item_id AS item, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def isolation_semi(spark, sf_dir):
    return corpus.contained(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query("SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1")
def union_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.overlap(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "text")


@query("""WITH c AS (SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, count(*) AS n FROM documents GROUP BY CUBE (lang, source))
SELECT lang, source, level, n, count(DISTINCT n) OVER (PARTITION BY level) = 1 AS even FROM c""")
def balance_cube(spark, sf_dir):
    return corpus.balance(table(spark, sf_dir, "documents"), "lang", "source")


@query("""WITH l AS (SELECT doc_id, unnest(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS label FROM labels),
f AS (SELECT label, count(*) AS n FROM l GROUP BY label), w AS (SELECT label, least(4.0::DOUBLE, (SELECT max(n) FROM f) / n) AS w FROM f), d AS (SELECT doc_id, max(w) AS w FROM l JOIN w USING (label) GROUP BY doc_id)
SELECT doc_id, CAST(round(coalesce(w, 0.25), 9) AS DOUBLE) AS weight FROM labels LEFT JOIN d USING (doc_id)""")
def balanced_weights(spark, sf_dir):
    labels = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    rows = corpus.label_weights(table(spark, sf_dir, "labels").withColumn("labels", labels), "doc_id", "labels")
    return rows.select("doc_id", F.round("weight", 9).alias("weight"))


@query("""WITH c AS (SELECT source, source IN ('src0', 'src1', 'src2', 'src3', 'src4') AS is_replay, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT sum(n) AS total FROM c)
SELECT source, is_replay, n, CAST(CASE WHEN is_replay THEN round_even(total * 0.7, 0) ELSE total - round_even(total * 0.7, 0) END AS BIGINT) AS side_quota FROM c, t""")
def replay_quota(spark, sf_dir):
    replay = F.col("source").isin("src0", "src1", "src2", "src3", "src4")
    return corpus.replay_quota(table(spark, sf_dir, "documents"), "source", replay, 0.7).select("source", "is_replay", "n", "side_quota")


_PHRASES = ["license", "worthless", "apache", "lorem ipsum", "idiot"]


@query("SELECT phrase, doc_id FROM documents, (SELECT unnest(['license', 'worthless', 'apache', 'lorem ipsum', 'idiot']) AS phrase) WHERE contains(lower(text), phrase)")
def forbidden_phrase(spark, sf_dir):
    phrases = spark.createDataFrame([(p,) for p in _PHRASES], "phrase string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    return corpus.contained(docs, phrases, "doc_id", "low", "phrase", "phrase").select(F.col("item").alias("phrase"), "doc_id")


@query("SELECT round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def p95_value(spark, sf_dir):
    p95 = select.quantile(table(spark, sf_dir, "events"), "value", 0.95)
    return spark.range(1).select(F.round(F.lit(p95).cast("double"), 6).alias("p95"))
