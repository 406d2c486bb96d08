"""Evaluation queries: predictions are gold spans, perturbed in known ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskframe.operators import corpus, evaluate
from maskframe.plans.tables import table

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _gold(spark, sf_dir):
    """A span for each line of an order: type by part, place by line."""
    type_ = F.element_at(F.array(*[F.lit(t) for t in ("PERSON", "ADDRESS", "ORG", "DOB")]), (F.col("l_partkey") % 4).cast("int") + 1)
    start = (F.col("l_linenumber") * 20).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), type_.alias("type"), start.alias("start"), (start + 10).alias("end"), F.col("l_suppkey").alias("k"))


def _predicted(gold):
    """Every 5th span is missed, every 7th cut short, every 11th doubled, every 13th has another type."""
    kept = gold.filter("k % 5 <> 0").withColumn("end", F.when(F.col("k") % 7 == 0, F.col("end") - 3).otherwise(F.col("end")))
    kept = kept.withColumn("type", F.when(F.col("k") % 13 == 0, F.lit("HEALTH")).otherwise(F.col("type")))
    return kept.unionByName(kept.filter("k % 11 = 0"))


_SPANS = """gold AS (SELECT l_orderkey AS doc_id, (['PERSON', 'ADDRESS', 'ORG', 'DOB'])[l_partkey % 4 + 1] AS type, CAST(l_linenumber * 20 AS INTEGER) AS a, CAST(l_linenumber * 20 + 10 AS INTEGER) AS b, l_suppkey AS k FROM lineitem),
kept AS (SELECT doc_id, CASE WHEN k % 13 = 0 THEN 'HEALTH' ELSE type END AS type, a, CASE WHEN k % 7 = 0 THEN b - 3 ELSE b END AS b, k FROM gold WHERE k % 5 <> 0),
pred AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE k % 11 = 0),
g AS (SELECT doc_id, type, a, b, row_number() OVER (PARTITION BY doc_id, type, a, b) AS n FROM gold),
p AS (SELECT doc_id, type, a, b, row_number() OVER (PARTITION BY doc_id, type, a, b) AS n FROM pred),
counts AS (SELECT coalesce(g.type, p.type) AS type, count(*) FILTER (WHERE g.a IS NOT NULL AND p.a IS NOT NULL) AS tp, count(*) FILTER (WHERE g.a IS NULL) AS fp, count(*) FILTER (WHERE p.a IS NULL) AS fn, count(g.a) AS support
  FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.type = p.type AND g.a = p.a AND g.b = p.b AND g.n = p.n GROUP BY 1)"""
_SCORES = "CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1"


@query(f"WITH {_SPANS} SELECT type, tp, fp, fn, support, {_SCORES} FROM counts")
def span_metrics_strict(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    return evaluate.with_scores(evaluate.strict(gold, _predicted(gold)))


@query(f"""WITH {_SPANS}, gs AS (SELECT doc_id, type, a, count(*) AS n_g FROM gold GROUP BY ALL), ps AS (SELECT doc_id, type, a, count(*) AS n_p FROM pred GROUP BY ALL), t AS (
  SELECT coalesce(gs.type, ps.type) AS type, CAST(sum(CASE WHEN n_g IS NULL OR n_p IS NULL THEN 0 ELSE least(n_g, n_p) END) AS BIGINT) AS tp, CAST(coalesce(sum(n_p), 0) AS BIGINT) AS n_p, CAST(coalesce(sum(n_g), 0) AS BIGINT) AS n_g
  FROM gs FULL JOIN ps ON gs.doc_id = ps.doc_id AND gs.type = ps.type AND gs.a = ps.a GROUP BY 1)
SELECT type, tp, n_p - tp AS fp, n_g - tp AS fn, n_g AS support FROM t""")
def span_metrics_partial(spark, sf_dir):
    """Spans of different lines lie apart here, so matches are made within a line."""
    gold = _gold(spark, sf_dir)
    rows = evaluate.partial(gold, _predicted(gold))
    return rows.select("type", *[F.col(c).cast("long").alias(c) for c in evaluate.COUNTS])


@query(f"""WITH {_SPANS}, s AS (SELECT *, {_SCORES} FROM counts), m AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM counts)
SELECT 'macro' AS average, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM s WHERE support > 0
UNION ALL SELECT 'micro', round(precision, 9), round(recall, 9), round(f1, 9) FROM (SELECT {_SCORES} FROM m)""")
def macro_micro(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    counts = evaluate.strict(gold, _predicted(gold))
    scores = [F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]
    return evaluate.macro(counts).select(F.lit("macro").alias("average"), *scores).unionByName(evaluate.micro(counts).select(F.lit("micro").alias("average"), *scores))


@query(f"""WITH {_SPANS}, bare AS (SELECT DISTINCT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM gold WHERE k % 3 = 0)), f AS (SELECT doc_id, count(*) AS n FROM pred GROUP BY 1)
SELECT count(*) AS documents, count(*) FILTER (WHERE n > 0) AS documents_with_false_positives, CAST(coalesce(sum(n), 0) AS BIGINT) AS false_positive_spans FROM bare LEFT JOIN f USING (doc_id)""")
def empty_gold_stats(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return evaluate.empty_gold(docs, gold.filter("k % 3 = 0"), _predicted(gold))


_STEPS = [round(0.1 * i, 2) for i in range(1, 10)]


@query(f"""WITH s AS (SELECT quality AS y, ((doc_id * 37) % 100) / 100.0::DOUBLE AS score FROM labels), t AS (SELECT CAST(unnest({_STEPS}) AS DOUBLE) AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE score < threshold AND y = 1) AS fn, count(*) FILTER (WHERE y = 1) AS support FROM t, s GROUP BY 1)
SELECT threshold, tp, fp, fn, support, {_SCORES} FROM c""")
def threshold_sweep(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").withColumn("score", (F.col("doc_id") * 37) % 100 / F.lit(100.0))
    return evaluate.sweep(scored, _STEPS, "quality", "score")


@query(f"""WITH {_SPANS}, c AS (SELECT type, {_SCORES} FROM counts WHERE support > 0), i AS (SELECT type, f1 * 0.9 AS f1 FROM c)
SELECT round(avg(c.f1), 9) AS candidate_macro_f1, round(avg(i.f1), 9) AS incumbent_macro_f1, count(*) FILTER (WHERE i.f1 - c.f1 > 0.02) AS n_regressions,
  avg(c.f1) - avg(i.f1) >= 0.05 AND count(*) FILTER (WHERE i.f1 - c.f1 > 0.02) = 0 AS adopt FROM c JOIN i USING (type)""")
def adoption_verdict(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    candidate = evaluate.with_scores(evaluate.strict(gold, _predicted(gold))).filter("support > 0")
    row = evaluate.verdict(candidate, candidate.withColumn("f1", F.col("f1") * 0.9))
    return row.select(F.round("candidate_macro_f1", 9).alias("candidate_macro_f1"), F.round("incumbent_macro_f1", 9).alias("incumbent_macro_f1"), F.size("regressions").cast("long").alias("n_regressions"), "adopt")


@query(f"""WITH {_SPANS}, s AS (SELECT type, support, {_SCORES} FROM counts), w AS (SELECT unnest(['PERSON', 'ADDRESS', 'ORG', 'DOB', 'UNION']) AS type)
SELECT type, CASE WHEN coalesce(support, 0) = 0 THEN 'no support' ELSE concat_ws(', ', CASE WHEN precision < 1 THEN 'precision' END, CASE WHEN recall < 0.99 THEN 'recall' END) END AS reasons
FROM w LEFT JOIN s USING (type) WHERE coalesce(support, 0) = 0 OR precision < 1 OR recall < 0.99""")
def l0_gate(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    scores = evaluate.with_scores(evaluate.strict(gold, _predicted(gold)))
    return evaluate.gate(scores, ["PERSON", "ADDRESS", "ORG", "DOB", "UNION"])


@query("SELECT o_orderpriority AS run, CAST(max(o_custkey) AS BIGINT) AS best FROM orders GROUP BY 1 ORDER BY best DESC, run DESC LIMIT 1")
def best_run(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.max("o_custkey").alias("best"))
    return evaluate.best_run(runs, "best", "run")


@query("SELECT o_orderkey AS step, CASE WHEN o_orderkey < 1000 THEN o_orderkey / 1000.0::DOUBLE ELSE greatest(0.0::DOUBLE, (20000 - o_orderkey) / 19000.0::DOUBLE) END AS scale FROM orders")
def warmup_schedule(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), corpus.warmup_decay(F.col("o_orderkey"), 1000, 20000).alias("scale"))


@query("SELECT t AS template_id, CAST(rep * 25 + t AS BIGINT) AS row, (['plain', 'ascii', 'lower', 'suffix'])[(t + rep) % 4 + 1] AS morphology FROM (SELECT CAST(n_nationkey AS BIGINT) AS t FROM nation), range(8) AS x(rep)")
def template_rows(spark, sf_dir):
    key = F.col("n_nationkey").cast("long")
    templates = table(spark, sf_dir, "nation").select(key.alias("row"), key.alias("template_id"), F.lit("d").alias("domain"), F.lit("p").alias("pattern"))
    return corpus.generate(templates, 8).select("template_id", F.col("row").cast("long").alias("row"), "morphology")


@query()
def epoch_sample(spark, sf_dir):
    """One balanced epoch: rows in proportion to their weight, with replacement."""
    labels = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "labels")
    weighted = corpus.label_weights(rows.withColumn("labels", labels), "doc_id", "labels")
    return corpus.sample(weighted, rows.count(), 7, 1, "doc_id").select("doc_id", "draw")
