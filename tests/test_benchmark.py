from pyspark.sql import functions as F

from maskframe.operators import benchmark, spans

GOLD = "id string, text string, entities array<struct<type:string,start:int,end:int>>"


def test_run_over_gold(spark):
    gold = spark.createDataFrame([("1", "x 10000000146", [("TR_TCKN", 2, 13)]), ("2", "a@b.co", [("EMAIL", 0, 4)]), ("3", "none", [])], GOLD)
    out = benchmark.run(gold, types=["TR_TCKN", "EMAIL"])
    assert {(r.type, r.tp, r.fp, r.fn) for r in out["strict"].collect()} == {("TR_TCKN", 1, 0, 0), ("EMAIL", 0, 1, 1)}
    assert {(r.type, r.tp) for r in out["partial"].collect()} == {("TR_TCKN", 1), ("EMAIL", 1)}
    assert [r.type for r in out["missed"].collect()] == ["EMAIL"]
    assert benchmark.report_rows(out["strict"]).first().type == "EMAIL"


def test_baseline_types(spark):
    df = spark.createDataFrame([("TR33 x", [("IBAN_CODE", 0, 4), ("URL", 0, 1), ("PERSON", 5, 6)])], "text string, s array<struct<type:string,start:int,end:int>>")
    assert [s.type for s in df.select(benchmark.baseline(F.col("s"), F.col("text")).alias("s")).first().s] == ["TR_IBAN", "PERSON"]


def test_negatives_and_metadata(spark):
    rows = spark.range(1).select(spans.candidate_spans(F.lit(30), 4).alias("c")).withColumn("p", F.slice("c", 1, 3))
    n = rows.select(benchmark.negatives(F.col("c"), F.col("p"), F.lit(1)).alias("n"), "p").first()
    assert len(n.n) == 24 and not {tuple(x) for x in n.n} & {tuple(x) for x in n.p}
    assert len(benchmark.metadata(spark).first().types) == 24
