"""Queries over stored tables, running state, keyed permutations and span scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from maskframe.operators import permute, policy, spanscores
from maskframe.plans import relational
from maskframe.plans.streams import _folder, drained
from maskframe.plans.tables import AUDIT_SQL, audit_log, table
from maskframe.sources import formats, readers
from maskframe.sources.tables import StoredLog, StoredVault
from maskframe.streaming import frames
from maskframe.streaming import vault as streamed

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


@query("""WITH e AS (SELECT event_id, user_id, 'v' || CAST(json_extract(props, '$.k') AS INTEGER) % 7 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events),
f AS (SELECT user_id, v, min(o) AS o FROM e WHERE event_id % 3 <> 0 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS n FROM f)
SELECT e.event_id AS seq, CASE WHEN event_id % 3 = 0 THEN '[KISI_1]' ELSE '[KISI_' || n.n || ']' END AS placeholder,
  CASE WHEN event_id % 3 <> 0 THEN CASE WHEN e.o = n.o THEN 'NEW' ELSE 'KNOWN' END WHEN e.o > a.o THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS state,
  CASE WHEN event_id % 3 <> 0 THEN e.v WHEN e.o > a.o THEN a.v END AS value
FROM e LEFT JOIN n ON e.event_id % 3 <> 0 AND n.user_id = e.user_id AND n.v = e.v LEFT JOIN n AS a ON a.user_id = e.user_id AND a.n = 1""")
def vault_stream_events(spark, sf_dir):
    """The vault as a running stream: each event of a user interns a value or resolves the user's first placeholder."""
    folder = _folder(spark)
    k = F.get_json_object("props", "$.k").cast("int")
    put = F.col("event_id") % 3 != 0
    rows = table(spark, sf_dir, "events").select(F.lit("tenant").alias("tenant_id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.when(put, "intern").otherwise("resolve").alias("op"), F.when(put, "PERSON").alias("type"), F.when(put, "KISI").alias("label"), F.when(put, F.concat(F.lit("v"), k % 7)).alias("value"), F.when(~put, "[KISI_1]").alias("placeholder"))
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(streamed.EVENTS).parquet(f"{folder}/in")
    return drained(streamed.vault_stream(stream, 10**12, clock="none"), folder).select("seq", "placeholder", "state", "value")


@query(relational.REGISTERED["rate_limit_fixed"][1].replace("SELECT user_id, event_id, c <= 2 AS allowed FROM walk", "SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, c <= 2 AS allowed FROM walk"))
def rate_limit_stream(spark, sf_dir):
    """The limiter as a running stream whose capacity is not reached."""
    folder = _folder(spark)
    table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("at")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("key string, seq bigint, at timestamp").parquet(f"{folder}/in")
    hits = drained(streamed.capped_limit_stream(stream, 2, 36 * 3_600_000, capacity=1 << 30), folder)
    return hits.select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "allowed")


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)
SELECT conv_id || '/' || turn AS resp_id, CAST(i AS BIGINT) AS n, CASE i WHEN 0 THEN 'delta' END AS event, CASE i WHEN 0 THEN replace(text, chr(10), ' ') ELSE '[DONE]' END AS data FROM t, range(2) AS x(i)""")
def frames_cut_anywhere(spark, sf_dir):
    """Each turn as two frames whose bytes come in pieces of eleven, line ends and characters cut as they fall."""
    folder = _folder(spark)
    flat = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    body = F.encode(F.concat(F.lit("event: delta\r\ndata: "), flat, F.lit("\r\n\r\ndata: [DONE]\n\n")), "UTF-8")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("resp_id"), body.alias("body"))
    n = F.ceil(F.octet_length("body") / 11).cast("int")
    pieces = turns.select("resp_id", "body", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    pieces.select("resp_id", F.col("i").cast("long").alias("seq"), F.substring(F.col("body"), F.col("i") * 11 + 1, F.lit(11)).alias("body"), (F.col("i") == F.col("n") - 1).alias("final")).write.parquet(f"{folder}/in")
    return drained(frames.frame_stream(spark.readStream.schema(frames.PIECES).parquet(f"{folder}/in")), folder).select("resp_id", "n", "event", "data")


@query(f"WITH {AUDIT_SQL} SELECT actor, true AS ok, count(*) AS verified FROM log GROUP BY actor")
def stored_log_verify(spark, sf_dir):
    """Every actor's records appended to a stored log in three batches, of which the second comes twice, and verified against its heads."""
    log = StoredLog(spark, f"{_folder(spark)}/log", "not-a-secret", buckets=8)
    rows = audit_log(spark, sf_dir).select(F.col("actor").alias("log"), F.concat_ws("|", "kind", F.col("k").cast("string")).alias("payload"), "seq")
    for part, batch in ((0, 0), (1, 1), (1, 1), (2, 2)):
        log.append(rows.filter(F.col("seq") % 3 == part), "seq", "query", batch)
    return log.verify().select(F.col("log").alias("actor"), "ok", "verified")


@query("""WITH v AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY ALL)
SELECT CAST(o_custkey AS VARCHAR) AS session_id, '[KURUM_' || row_number() OVER (PARTITION BY o_custkey ORDER BY f, o_orderpriority) || ']' AS placeholder, o_orderpriority AS value FROM v""")
def stored_vault_resolve(spark, sf_dir):
    """Values interned into a stored, sealed vault, a batch that comes again, and all resolved from the files."""
    vault = StoredVault(spark, f"{_folder(spark)}/vault", b"0123456789abcdef", "not-a-secret", buckets=8)
    values = table(spark, sf_dir, "orders").select(F.lit("tenant").alias("tenant_id"), F.col("o_custkey").cast("string").alias("session_id"), F.lit("ORG").alias("type"), F.lit("KURUM").alias("label"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("first_seen"))
    now, later = F.lit("2030-01-01").cast("timestamp"), F.lit("2100-01-01").cast("timestamp")
    for _ in range(2):
        vault.intern(values, later, now, "query", 0)
    wanted = vault.table.snapshot().rows().select("tenant_id", "session_id", "placeholder")
    return vault.resolve(wanted, now).select("session_id", "placeholder", "value")


@query("SELECT count(*) AS n, count(*) AS n_places, CAST(0 AS BIGINT) AS lowest, count(*) - 1 AS highest, CAST(count(*) // 2 - count(*) // 4 AS BIGINT) AS n_slice FROM customer")
def epoch_bijection(spark, sf_dir):
    """An epoch's places of all customers, and a slice of it that is looked up alone and must agree."""
    order = Window.orderBy("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.row_number().over(order) - 1).cast("long").alias("row"))  # a column of keys
    n = rows.count()
    whole = permute.epoch(rows, "row", n, 7, 1)
    part = permute.epoch_slice(rows, "row", n, 7, 1, n // 4, n // 2).select("c_custkey", "place").join(whole.select("c_custkey", "place"), ["c_custkey", "place"])
    total = whole.agg(F.count("*").alias("n"), F.countDistinct("place").alias("n_places"), F.min("place").alias("lowest"), F.max("place").alias("highest"))
    return total.join(F.broadcast(part.agg(F.count("*").alias("n_slice"))))  # one row each


@query("""WITH t AS (SELECT vec_id // 16 AS text_id, vec_id % 16 AS pos, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.text_id, a.pos AS first, b.pos AS last, x.k AS label, avg(c.e[x.k]) AS score
  FROM t AS a JOIN t AS b ON a.text_id = b.text_id AND b.pos BETWEEN a.pos AND a.pos + 4 JOIN t AS c ON c.text_id = a.text_id AND c.pos BETWEEN a.pos AND b.pos, range(1, 4) AS x(k) GROUP BY a.text_id, a.pos, b.pos, x.k)
SELECT text_id, CAST(first AS INTEGER) AS "first", CAST(last AS INTEGER) AS "last", 'axis' || label AS label, round(score, 6) AS score
FROM s QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY score DESC, last - first, first) = 1""")
def best_span_scores(spark, sf_dir):
    """Sixteen vectors make a text; its best span of up to five by three labels' directions."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    tokens = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("text_id"), (F.col("vec_id") % 16).alias("pos"), vector.alias("e"))
    texts = tokens.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("t")).select("text_id", F.transform("t", lambda x: x["e"]).alias("vectors"))
    labels = {f"axis{k + 1}": [1.0 if i == k else 0.0 for i in range(64)] for k in range(3)}
    found = spanscores.scored(texts, "vectors", labels, 5, -1e9).select("text_id", F.inline("spans"))
    first = F.row_number().over(Window.partitionBy("text_id").orderBy(F.desc("score"), F.col("last") - F.col("first"), "first"))
    return found.withColumn("r", first).filter("r = 1").select("text_id", "first", "last", "label", F.round("score", 6).alias("score"))


@query("""WITH t AS (SELECT DISTINCT p_type AS type, min(p_brand) OVER (PARTITION BY p_type) AS kvkk_class FROM part),
by_type AS (SELECT p_type AS type, arg_min(CASE p_size % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'mask' ELSE 'block' END, p_size) AS action FROM part WHERE p_size >= 25 GROUP BY 1),
by_class AS (SELECT kvkk_class, CASE WHEN min(type) < 'L' THEN 'mask' ELSE 'allow' END AS action FROM t GROUP BY 1 HAVING count(*) % 2 = 0)
SELECT type, t.kvkk_class, coalesce(a.action, b.action, 'block') AS action FROM t LEFT JOIN by_type AS a USING (type) LEFT JOIN by_class AS b ON b.kvkk_class = t.kvkk_class""")
def policy_actions_parts(spark, sf_dir):
    """Actions of all types of parts under rules drawn from the parts: large sizes name their types, some brands are classes."""
    part = table(spark, sf_dir, "part")
    types = part.groupBy(F.col("p_type").alias("type")).agg(F.min("p_brand").alias("kvkk_class"))
    named = part.filter("p_size >= 25").groupBy("p_size").agg(F.collect_set("p_type").alias("types"))
    kind = F.col("p_size") % 3
    rules = named.select(F.col("p_size").cast("int").alias("rule_idx"), "types", F.lit(None).cast("string").alias("kvkk_class"), F.when(kind == 0, "allow").when(kind == 1, "mask").otherwise("block").alias("action"))
    classes = types.groupBy("kvkk_class").agg(F.count("*").alias("n"), F.min("type").alias("least")).filter("n % 2 = 0")
    more = classes.select(F.lit(1).alias("rule_idx"), F.lit(None).cast("array<string>").alias("types"), "kvkk_class", F.when(F.col("least") < "L", "mask").otherwise("allow").alias("action"))
    return policy.actions(types, rules.unionByName(more)).select("type", "kvkk_class", "action")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(coalesce(text, '')) + 2 AS INTEGER) AS n, CASE WHEN doc_id % 5 = 0 THEN 'BAD_ENTITY' END AS error_code FROM documents")
def gold_source(spark, sf_dir):
    """All documents as gold lines, every fifth with an entity off its text, read back by byte ranges."""
    folder = f"{_folder(spark)}/gold"
    text = F.concat(F.lit("A "), F.coalesce("text", F.lit("")))
    entity = F.struct(F.lit("PERSON").alias("type"), F.lit(0).alias("start"), F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1).alias("end"), F.lit("A").alias("text"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("web").alias("domain"), F.lit("t").alias("template_id"), F.array(F.lit("plain")).alias("morphology"), text.alias("text"), F.array(entity).alias("entities"))
    readers.write_json_lines(rows, folder)
    formats.register(spark)
    return spark.read.format("gold").option("split_bytes", 1 << 20).load(folder).select("id", F.length("text").alias("n"), "error_code")


@query(f"WITH {AUDIT_SQL} SELECT seq, kind, actor, type, CAST(k AS INTEGER) AS n FROM log WHERE seq BETWEEN 100 AND 2099")
def audit_source_range(spark, sf_dir):
    """The log written by the audit format in the order of seq, and a range of it that reaches the files."""
    folder = f"{_folder(spark)}/audit"
    formats.register(spark)
    none = F.lit(None).cast("string")
    rows = audit_log(spark, sf_dir).select("seq", F.col("ts").cast("timestamp").alias("ts"), "kind", "actor", none.alias("session_id"), none.alias("request_sha256"), "entities", none.alias("prev_hash"), none.alias("hash"))
    rows.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.format("audit").mode("append").save(folder)
    got = formats.audit_range(spark, folder, 100, 2099, ordered="true", split_bytes=1 << 16)
    return got.select("seq", "kind", "actor", F.inline("entities")).select("seq", "kind", "actor", "type", F.col("count").alias("n"))

