"""Benchmark runs of the detector over gold examples, and what a run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators import detect, evaluate
from maskframe.taxonomy import DETERMINISTIC, TYPES

#: Types that a plain pattern detector names otherwise.
BASELINE_TYPES = {"EMAIL_ADDRESS": "EMAIL", "IBAN_CODE": "IBAN_OTHER", "PHONE_NUMBER": "TR_PHONE", "CREDIT_CARD": "CREDIT_CARD", "PERSON": "PERSON", "LOCATION": "ADDRESS", "ORGANIZATION": "ORG"}


def flat(rows: DataFrame, spans: str) -> DataFrame:
    """(doc_id, type, start, end) of an array of spans."""
    return rows.select(F.col("id").alias("doc_id"), F.explode(spans).alias("s")).select("doc_id", "s.type", "s.start", "s.end")


def run(gold: DataFrame, types: list[str] = DETERMINISTIC, model=None) -> dict[str, DataFrame]:
    """Detects over gold rows (id, text, entities) and evaluates: strict and partial counts with scores, and the gate's misses."""
    found = flat(detect.analyze(gold.select("id", "text"), types=types, model=model), "spans")
    wanted = flat(gold, "entities").filter(F.col("type").isin(types))
    strict = evaluate.with_scores(evaluate.strict(wanted, found))
    return {"strict": strict, "partial": evaluate.with_scores(evaluate.partial(wanted, found)), "missed": evaluate.gate(strict, [t for t in types if t in DETERMINISTIC])}


def report_rows(scores: DataFrame) -> DataFrame:
    """Types by recall, worst first."""
    return scores.orderBy("recall", "type")


def baseline(spans: Column, text: Column) -> Column:
    """Spans of a plain detector under our types; an IBAN that starts with TR is a Turkish one, unknown types go."""
    known = F.create_map(*[F.lit(x) for kv in BASELINE_TYPES.items() for x in kv])
    named = F.transform(spans, lambda s: s.withField("type", F.element_at(known, s["type"])))
    turkish = lambda s: (s["type"] == "IBAN_OTHER") & (F.substring(text, s["start"] + 1, F.lit(2)) == "TR")
    typed = F.transform(named, lambda s: s.withField("type", F.when(turkish(s), F.lit("TR_IBAN")).otherwise(s["type"])))
    return F.filter(typed, lambda s: s["type"].isNotNull())


def negatives(candidates: Column, positives: Column, seed: Column, least: int = 16, ratio: int = 8) -> Column:
    """Training negatives: candidate spans (first, last) that are not positive, ``max(least, ratio * positives)`` of them in the order of a hash."""
    rest = F.filter(candidates, lambda c: ~F.exists(positives, lambda p: (p["first"] == c["first"]) & (p["last"] == c["last"])))
    ranked = F.array_sort(F.transform(rest, lambda c: F.struct(F.xxhash64(seed, c["first"], c["last"]).alias("h"), c.alias("c"))))
    return F.transform(F.slice(ranked, F.lit(1), F.greatest(F.lit(least), F.size(positives) * ratio)), lambda x: x["c"])


def metadata(spark: SparkSession, model: str = "deterministic-v1") -> DataFrame:
    """One row about the engine: its types, model and number of recognizers."""
    from maskframe.functions.recognizers import RECOGNIZERS

    return spark.createDataFrame([(1, TYPES, DETERMINISTIC, model, len(RECOGNIZERS))], "taxonomy_version int, types array<string>, deterministic array<string>, model string, recognizers int")


def health(spark: SparkSession, model_ready: bool = True) -> DataFrame:
    """One row: whether the recognizers find what they should in a fixed text, and whether the model is ready."""
    probe = spark.createDataFrame([("x 10000000146 a@mail.com",)], "text string")
    found = detect.analyze(probe).select((F.size("spans") == 2).alias("recognizers"))
    return found.select("recognizers", F.lit(model_ready).alias("model"), (F.col("recognizers") & F.lit(model_ready)).alias("ready"))
