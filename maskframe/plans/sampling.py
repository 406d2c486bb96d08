"""Queries of exact draws, set tests, gates and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskframe import taxonomy as tax
from maskframe.operators import audit, corpus, evaluate, policy, vault
from maskframe.plans.evaluation import _SCORES, _SPANS, _gold, _predicted
from maskframe.plans.tables import AUDIT_SQL, audit_log, table
from maskframe.sources import readers

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


_WEIGHTS = "w AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 4.0::DOUBLE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS weight FROM labels)"


def _weighted(spark, sf_dir):
    weight = F.when(F.col("toxic") == 1, 4.0).when(F.col("quality") == 1, 1.0).otherwise(0.25)
    return table(spark, sf_dir, "labels").select("doc_id", weight.alias("weight"))


def _draws(rows: str, n: str, seed: str, shift: str = "0") -> str:
    point = f"CAST('0x' || substr(sha256('{seed}:' || i), 1, 15) AS BIGINT) % (SELECT CAST(sum(weight * 1048576) AS BIGINT) FROM {rows})"
    return f"""(SELECT s.doc_id, i + {shift} AS draw FROM (SELECT i, {point} AS at FROM range(CAST({n} AS BIGINT)) AS r(i)) p
  JOIN (SELECT doc_id, weight * 1048576 AS weight, sum(weight * 1048576) OVER (ORDER BY doc_id) AS upto FROM {rows}) s ON p.at >= s.upto - s.weight AND p.at < s.upto)"""


@query(f"WITH {_WEIGHTS} SELECT doc_id, CAST(draw AS BIGINT) AS draw FROM {_draws('w', '1000', 'balanced:7:1')}")
def balanced_draw(spark, sf_dir):
    """A thousand draws with replacement, in proportion to weights."""
    return corpus.draw(_weighted(spark, sf_dir), 1000, "balanced:7:1", "doc_id").select("doc_id", "draw")


@query(f"""WITH {_WEIGHTS}, old AS (SELECT * FROM w WHERE doc_id % 3 = 0), new AS (SELECT * FROM w WHERE doc_id % 3 <> 0), n AS (SELECT round_even((SELECT count(*) FROM w) * 0.7, 0) AS k, (SELECT count(*) FROM w) AS n)
SELECT doc_id, CAST(draw AS BIGINT) AS draw FROM {_draws('old', '(SELECT k FROM n)', 'replay:7:1:replay')} UNION ALL SELECT doc_id, CAST(draw AS BIGINT) FROM {_draws('new', '(SELECT n - k FROM n)', 'replay:7:1:new', '(SELECT k FROM n)')}""")
def replay_draw(spark, sf_dir):
    """An epoch of seven old rows in ten, each side drawn by its own weights."""
    return corpus.replay_draw(_weighted(spark, sf_dir), F.col("doc_id") % 3 == 0, 0.7, "replay:7:1", "doc_id").select("doc_id", "draw")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) < 6 UNION ALL SELECT n_regionkey + 100, count(*) FROM nation WHERE n_nationkey < 20 GROUP BY 1 HAVING count(*) < 5")
def thin_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    few = rows.filter("n_nationkey < 20").withColumn("n_regionkey", F.col("n_regionkey") + 100)
    return corpus.thin_groups(rows, "n_regionkey", 6).unionByName(corpus.thin_groups(few, "n_regionkey", 5))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 7 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 1")
def not_within(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return corpus.not_within(rows.filter("o_orderkey % 7 = 0"), rows.filter("o_orderkey % 7 = 1"), "k")


@query("SELECT doc_id, 0 AS part FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 2 = 1")
def ordered_union(spark, sf_dir):
    """Two halves that share no id, one after the other; halves that share one are refused (in the tests)."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return corpus.ordered_union(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), ("doc_id",))


@query("SELECT CAST(max(l_suppkey % 20 + 1) AS INTEGER) AS width FROM lineitem")
def widest_span(spark, sf_dir):
    first = (F.col("l_partkey") % 60).cast("int")
    span = F.struct(first.alias("first"), (first + (F.col("l_suppkey") % 20).cast("int")).alias("last"))
    return corpus.widest(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(span).alias("ner")))


@query("""WITH d AS (SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS d FROM orders),
r AS (SELECT o_orderkey // 1000 AS block, sha256(string_agg(d, chr(10) ORDER BY o_orderkey)) AS d FROM d GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY block)) AS sha256 FROM r""")
def corpus_digest(spark, sf_dir):
    return corpus.ordered_digest(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", "o_orderkey", "o_custkey", "o_orderstatus")


@query(f"WITH {_SPANS}, s AS (SELECT type, support, {_SCORES} FROM counts) SELECT round(avg(f1) FILTER (WHERE type IN ('PERSON', 'ADDRESS', 'ORG', 'DOB')), 9) AS macro_f1, '' AS missing FROM s UNION ALL SELECT NULL, 'HEALTH,UNION'")
def mandatory_macro(spark, sf_dir):
    """The average over types that must all have support, and what is said where some have none."""
    gold = _gold(spark, sf_dir)
    counts = evaluate.strict(gold, _predicted(gold))
    some, all_ = (evaluate.mandatory_macro(counts, t) for t in (["PERSON", "ADDRESS", "ORG", "DOB"], ["PERSON", "HEALTH", "UNION"]))
    return some.unionByName(all_).select(F.round("macro_f1", 9).alias("macro_f1"), F.array_join("missing", ",").alias("missing"))


@query(f"WITH {_SPANS} SELECT string_agg(type, ',' ORDER BY type) AS types FROM counts WHERE support > 0")
def supported_types(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    return evaluate.supported_types(evaluate.strict(gold, _predicted(gold))).select(F.array_join("types", ",").alias("types"))


@query(f"""WITH {_SPANS}, s AS (SELECT type, {_SCORES} FROM counts WHERE support > 0) SELECT round(greatest(0.0, max(f1 - f1 * (CASE type WHEN 'ORG' THEN 0.5 WHEN 'DOB' THEN 1.2 ELSE 0.9 END)::DOUBLE)), 9) AS worst FROM s""")
def worst_regression(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    rows = evaluate.with_scores(evaluate.strict(gold, _predicted(gold))).filter("support > 0")
    factor = F.when(F.col("type") == "ORG", 0.5).when(F.col("type") == "DOB", 1.2).otherwise(0.9)
    return evaluate.worst_regression(rows.withColumn("f1", F.col("f1") * factor), rows).select(F.round("worst", 9).alias("worst"))


@query("""WITH r AS (SELECT o_orderkey AS run, o_orderkey % 2 = 1 AS complete, o_orderkey % 3 = 2 AS eligible, 500 - o_orderkey % 4 // 3 AS steps, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS loss, o_orderkey % 5 AS peak FROM orders)
SELECT run, concat_ws(',', CASE WHEN complete THEN 'not an open pilot' END, CASE WHEN eligible THEN 'eligible for adoption' END, CASE WHEN steps <> 500 THEN 'steps' END, CASE WHEN loss IS NULL THEN 'final loss' END, CASE WHEN peak = 0 OR peak = 4 THEN 'memory' END) AS reasons,
  NOT complete AND NOT eligible AND steps = 500 AND loss IS NOT NULL AND peak BETWEEN 1 AND 3 AS pass FROM r""")
def pilot_gate(spark, sf_dir):
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(
        k.alias("run"), F.lit("pilot").alias("run_kind"), (k % 2 == 1).alias("complete"), (k % 3 == 2).alias("adoption_eligible"), F.lit(500).alias("max_steps"), (F.lit(500) - F.floor(k % 4 / 3)).alias("optimizer_steps"),
        F.lit("max-steps").alias("stop_reason"), F.lit(0.5).alias("mean_loss"), F.when(k % 7 > 0, F.col("o_totalprice")).alias("final_loss"), (k % 5 * F.lit(20 << 30)).alias("peak_bytes"), F.lit("bf16").alias("amp"), F.lit(True).alias("development_gate_pass"),
    )
    return evaluate.pilot_gate(runs).select("run", F.array_join("reasons", ",").alias("reasons"), "pass")


@query("""WITH listed AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 > 0), found AS (SELECT o_orderkey AS k, o_orderkey % 13 = 0 AS changed FROM orders WHERE o_orderkey % 17 > 0)
SELECT 'f' || coalesce(l.k, f.k) AS path, CASE WHEN f.k IS NULL THEN 'missing' WHEN l.k IS NULL THEN 'unlisted' ELSE 'differs' END AS problem FROM listed l FULL JOIN found f ON l.k = f.k WHERE f.k IS NULL OR l.k IS NULL OR f.changed""")
def bundle_check(spark, sf_dir):
    """Listed against found files: every 11th is not listed, every 17th missing, every 13th changed."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("f"), k.cast("string")).alias("path"), F.sha2(k.cast("string"), 256).alias("sha256"))
    found = rows.filter(k % 17 > 0).withColumn("sha256", F.when(k % 13 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return readers.check_bundle(rows.filter(k % 11 > 0).drop("o_orderkey"), found.drop("o_orderkey"))


@query("""SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 17 = 0 THEN 'missing' WHEN o_orderkey % 13 = 0 THEN 'length' ELSE 'digest' END AS problem FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 19 = 0""")
def lock_check(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("f"), k.cast("string")).alias("path"), F.lit(10).alias("length"), F.sha2(k.cast("string"), 256).alias("sha256"))
    found = rows.filter(k % 17 > 0).withColumns({"length": F.when(k % 13 == 0, 11).otherwise(10), "sha256": F.when(k % 19 == 0, F.lit("x")).otherwise(F.col("sha256"))})
    return readers.verify_lock(rows.drop("o_orderkey"), found.drop("o_orderkey"))


@query(f"""WITH {_SPANS}, pooled AS (SELECT * FROM counts UNION ALL SELECT type, CAST(count(*) AS BIGINT) AS tp, 0, 0, count(*) FROM gold GROUP BY type)
SELECT type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(support) AS BIGINT) AS support FROM pooled GROUP BY type""")
def combined_suites(spark, sf_dir):
    """A suite of perturbed predictions and one of perfect ones, added up."""
    gold = _gold(spark, sf_dir)
    return evaluate.combine(evaluate.strict(gold, _predicted(gold)), evaluate.strict(gold, gold)).select("type", "tp", "fp", "fn", "support")


@query("""WITH r AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS scope, o_orderkey % 4 + 1 AS n FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY scope, n ORDER BY k) = 1 AND n <> 2 AS free FROM r)
SELECT k, '[KISI_' || CASE WHEN free THEN n ELSE greatest(max(n) OVER (PARTITION BY scope), 2) + row_number() OVER (PARTITION BY scope, free ORDER BY k) END || ']' AS given FROM f""")
def vault_allocate(spark, sf_dir):
    """Placeholders asked for in every scope, of which the second is taken beforehand."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("tenant_id"), F.lit("s").alias("session_id"), F.concat(F.lit("[KISI_"), (F.col("o_orderkey") % 4 + 1).cast("string"), F.lit("]")).alias("placeholder"))
    taken = rows.select("tenant_id", "session_id", F.lit("[KISI_2]").alias("placeholder")).distinct()
    return vault.allocate(taken, rows, "k").select("k", "given")


@query("SELECT 'TR_VKN' AS type, 'missing' AS problem UNION ALL SELECT 'EMAIL', 'repeated' UNION ALL SELECT 'NEW', 'unknown type' UNION ALL SELECT 'ORG', 'not alone' UNION ALL SELECT 'PERSON', 'not alone' UNION ALL SELECT 'DOB', 'action'")
def full_matrix(spark, sf_dir):
    """What a matrix of one rule for each type lacks."""
    rules = [([t], "mask") for t in tax.TYPES if t not in ("TR_VKN", "ORG", "PERSON", "DOB")] + [(["EMAIL"], "block"), (["NEW"], "mask"), (["ORG", "PERSON"], "mask"), (["DOB"], "hide")]
    table_ = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(rules)], "rule_idx int, types array<string>, action string")
    return policy.full_matrix(table_, tax.taxonomy(spark))


@query(f"WITH {AUDIT_SQL}, t AS (SELECT type, CAST(sum(k) AS BIGINT) AS total FROM log GROUP BY type ORDER BY total DESC, type LIMIT 8) SELECT type, total, round(total / (SELECT max(total) FROM t), 9) AS share FROM t")
def audit_bars(spark, sf_dir):
    return audit.bars(audit_log(spark, sf_dir)).select("type", "total", F.round("share", 9).alias("share"))


@query(f"""WITH {AUDIT_SQL} SELECT seq, '{{"actor":"' || actor || '","entities":[{{"action":"mask","count":' || k || ',"type":"' || type || '"}}],"kind":"' || kind || '","seq":' || seq || ',"session_id":null}}' AS line FROM log""")
def canonical_lines(spark, sf_dir):
    """Records as canonical JSON, nested keys in order."""
    rows = audit_log(spark, sf_dir).withColumn("session_id", F.lit(None).cast("string"))
    return rows.select("seq", audit.canonical(rows, "seq", "kind", "actor", "entities", "session_id").alias("line"))


@query("SELECT user_id FROM (SELECT user_id, min(ts) AS opened FROM events GROUP BY 1) WHERE opened + INTERVAL 20 DAY > TIMESTAMP '2024-01-21 12:00:00' ORDER BY opened DESC, user_id DESC LIMIT 20")
def limiter_capacity(spark, sf_dir):
    """Rate-limit windows that a limiter of twenty keys still holds."""
    opened = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.min("ts").alias("opened_at")).withColumn("ends_at", F.col("opened_at") + F.expr("INTERVAL 20 DAYS"))
    return vault.within_capacity(opened, F.lit("2024-01-21 12:00:00").cast("timestamp_ntz"), 20).select(F.col("key").alias("user_id"))


@query("""WITH g AS (SELECT o_orderkey AS doc, o_orderpriority AS suite, o_orderstatus AS type, CAST(o_orderkey % 50 AS INTEGER) AS a FROM orders), p AS (SELECT * FROM g WHERE doc % 4 > 0 UNION ALL SELECT doc, suite, type, a + 1 FROM g WHERE doc % 9 = 0)
SELECT suite, type, CAST(sum(hit) AS BIGINT) AS tp, CAST(sum(n_p - hit) AS BIGINT) AS fp, CAST(sum(n_g - hit) AS BIGINT) AS fn FROM (SELECT suite, type, doc, a, max(g) AS n_g, max(p) AS n_p, least(max(g), max(p)) AS hit FROM (SELECT suite, type, doc, a, 1 AS g, 0 AS p FROM g UNION ALL SELECT suite, type, doc, a, 0, 1 FROM p) GROUP BY ALL) GROUP BY ALL""")
def suite_metrics(spark, sf_dir):
    """Several suites evaluated in one pass."""
    start = (F.col("o_orderkey") % 50).cast("int")
    gold = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("suite"), F.col("o_orderstatus").alias("type"), start.alias("start"), (start + 3).alias("end"))
    wrong = gold.filter("doc_id % 9 = 0").withColumns({"start": F.col("start") + 1, "end": F.col("end") + 1})
    return evaluate.suites(gold, gold.filter("doc_id % 4 > 0").unionByName(wrong), "suite").select("suite", "type", "tp", "fp", "fn")


@query("""WITH RECURSIVE g AS (SELECT l_orderkey AS doc, list_sort(list({'a': CAST(l_partkey % 60 AS INTEGER), 'b': CAST(l_partkey % 60 + 1 + l_suppkey % 20 AS INTEGER)})) AS g FROM lineitem GROUP BY 1),
p AS (SELECT doc, a, b, row_number() OVER (PARTITION BY doc ORDER BY a, b) AS n FROM (SELECT l_orderkey AS doc, CAST(l_partkey % 60 + 3 AS INTEGER) AS a, CAST(l_partkey % 60 + 9 AS INTEGER) AS b FROM lineitem WHERE l_linenumber % 3 > 0)),
walk AS (SELECT doc, CAST(0 AS BIGINT) AS n, g AS rest FROM g UNION ALL
  SELECT w.doc, p.n, CASE WHEN len(list_filter(w.rest, lambda x: x.a < p.b AND p.a < x.b)) = 0 THEN w.rest ELSE
    list_concat(w.rest[1:list_position(list_transform(w.rest, lambda x: x.a < p.b AND p.a < x.b), true) - 1], w.rest[list_position(list_transform(w.rest, lambda x: x.a < p.b AND p.a < x.b), true) + 1:]) END
  FROM walk w JOIN p ON p.doc = w.doc AND p.n = w.n + 1),
last AS (SELECT doc, max(n) AS n_p, arg_max(len(rest), n) AS missed FROM walk GROUP BY doc)
SELECT 'EMAIL' AS type, CAST(sum(len(g) - missed) AS BIGINT) AS tp, CAST(sum(n_p - len(g) + missed) AS BIGINT) AS fp, CAST(sum(missed) AS BIGINT) AS fn, CAST(sum(len(g)) AS BIGINT) AS support FROM last JOIN g USING (doc)""")
def partial_crossing(spark, sf_dir):
    """Partial matches where spans of a document cross each other, so that the order of first fits decides."""
    start = (F.col("l_partkey") % 60).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("EMAIL").alias("type"), start.alias("start"), (start + 1 + (F.col("l_suppkey") % 20).cast("int")).alias("end"), "l_linenumber")
    found = rows.filter("l_linenumber % 3 > 0").select("doc_id", "type", (F.col("start") + 3).alias("start"), (F.col("start") + 9).alias("end"))
    return evaluate.partial(rows.drop("l_linenumber"), found).select("type", "tp", "fp", "fn", "support")


@query("""WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS scope, o_orderstatus AS label, CAST(max(o_orderkey % 99 + 1) AS INTEGER) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
s AS (SELECT CAST(o_custkey AS VARCHAR) AS scope, o_orderstatus AS label, CAST(max(o_orderkey % 99 + 1) AS INTEGER) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
SELECT scope, label, CASE WHEN s.n IS NULL THEN c.n WHEN c.n IS NULL THEN s.n ELSE greatest(c.n + 1, s.n) END AS last_n FROM c FULL JOIN s USING (scope, label)""")
def counter_upsert(spark, sf_dir):
    """Counters of one half of the orders, after the other half was seen."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("scope"), F.col("o_orderstatus").alias("label"), (F.col("o_orderkey") % 99 + 1).cast("int").alias("last_n"))
    known = rows.filter("o_orderkey % 2 = 0").groupBy("scope", "label").agg(F.max("last_n").alias("last_n"))
    return vault.upsert_counters(known, rows.filter("o_orderkey % 2 = 1"), ["scope"])


@query(f"""WITH {AUDIT_SQL}, p AS (SELECT * FROM log WHERE ts >= '2024-01-05 00:00:00' AND ts <= '2024-01-14 23:59:59.999')
SELECT count(*) AS events, CAST(coalesce(sum(k), 0) AS BIGINT) AS masked, false AS chain_ok, CAST(500 AS BIGINT) AS first_broken_seq FROM p""")
def audit_audited_report(spark, sf_dir):
    """A period's totals with the state of a log whose 500th record was changed."""
    rows = audit_log(spark, sf_dir).withColumn("payload", F.concat_ws("|", F.col("seq").cast("string"), "kind", "actor"))
    own = rows.withColumn("hash", F.sha2("payload", 256))
    before = own.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("prev_hash"))
    stored = own.join(before, "seq", "left").withColumn("prev_hash", F.coalesce("prev_hash", F.lit(audit.GENESIS))).withColumn("payload", F.when(F.col("seq") == 500, "x").otherwise(F.col("payload")))
    return audit.audited_report(stored, F.sha2("payload", 256), "2024-01-05", "2024-01-14").select("events", "masked", "chain_ok", "first_broken_seq")


@query("SELECT c_custkey, replace(replace(rtrim(base64(encode(c_name)), '='), '+', '-'), '/', '_') AS name, c_name AS back FROM customer")
def base64url_names(spark, sf_dir):
    coded = vault.base64url(F.col("c_name").cast("binary"))
    return table(spark, sf_dir, "customer").select("c_custkey", coded.alias("name"), vault.from_base64url(coded).cast("string").alias("back"))
