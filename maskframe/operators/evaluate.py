"""Span metrics, threshold sweeps, gates and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskframe.taxonomy import DETERMINISTIC

COUNTS = ("tp", "fp", "fn", "support")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; an empty denominator gives 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2.0 * tp, 2 * tp + fp + fn)})


def _numbered(spans: DataFrame, doc: str, name: str, keys: list[str]) -> DataFrame:
    """Repeated spans get different numbers, so that each matches once."""
    n = F.row_number().over(Window.partitionBy(doc, "type", "start", "end", *keys).orderBy(F.lit(1)))
    return spans.select(*keys, doc, "type", "start", "end").withColumn("__n", n).withColumn(name, F.lit(1))


def strict(gold: DataFrame, predicted: DataFrame, doc: str = "doc_id", keys: list[str] | None = None) -> DataFrame:
    """Counts by type where a span matches one with equal type, start and end. ``keys`` (of predictions) evaluate several runs at once; gold then has them too."""
    keys = keys or []
    both = _numbered(gold, doc, "g", keys).join(_numbered(predicted, doc, "p", keys), [*keys, doc, "type", "start", "end", "__n"], "full")
    hit = F.col("g").isNotNull() & F.col("p").isNotNull()
    return both.groupBy(*keys, "type").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"), F.count("g").alias("support"))


def partial(gold: DataFrame, predicted: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Counts by type where each prediction, in order, takes the first untaken gold span of its document and type that it overlaps.

    The spans of one document and type are folded together; a document bounds them.
    """
    span = lambda df, name: df.groupBy(doc, "type").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))
    both = span(gold, "g").join(span(predicted, "p"), [doc, "type"], "full")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    g, p = F.coalesce("g", empty), F.coalesce("p", empty)

    def take(left: Column, s: Column) -> Column:
        fits = F.filter(left, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))
        at = F.array_position(left, F.get(fits, F.lit(0))).cast("int")
        return F.when(F.size(fits) > 0, F.concat(F.slice(left, F.lit(1), at - 1), F.slice(left, at + 1, F.size(left)))).otherwise(left)

    left = F.aggregate(p, g, take)
    rows = both.select("type", (F.size(g) - F.size(left)).alias("tp"), F.size(p).alias("n_p"), F.size(g).alias("n_g"))
    return rows.groupBy("type").agg(F.sum("tp").alias("tp"), F.sum(F.col("n_p") - F.col("tp")).alias("fp"), F.sum(F.col("n_g") - F.col("tp")).alias("fn"), F.sum("n_g").alias("support"))


def macro(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Average scores over types with support."""
    rows = with_scores(counts).filter("support > 0").groupBy(*(keys or []))
    return rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def micro(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return with_scores(counts.groupBy(*(keys or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]))


def combine(*suites: DataFrame) -> DataFrame:
    """Counts of several suites, added exactly."""
    return reduce(DataFrame.unionByName, suites).groupBy("type").agg(*[F.sum(c).alias(c) for c in COUNTS])


def empty_gold(docs: DataFrame, gold: DataFrame, predicted: DataFrame, doc: str = "doc_id") -> DataFrame:
    """False positives on documents without gold spans."""
    bare = docs.select(doc).distinct().join(gold.select(doc).distinct(), doc, "left_anti")
    per_doc = bare.join(predicted.groupBy(doc).agg(F.count("*").alias("n")), doc, "left")
    return per_doc.agg(F.count("*").alias("documents"), F.count_if(F.col("n") > 0).alias("documents_with_false_positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("false_positive_spans"))


def sweep(scored: DataFrame, thresholds: list[float], label: str, score: str) -> DataFrame:
    """Counts and scores of ``score >= threshold`` for every threshold, from one pass.

    Each row adds to the thresholds at or below its score: it is counted once at the highest
    one, and running sums over the few thresholds do the rest.
    """
    ranked = sorted(set(thresholds))
    met = reduce(Column.__add__, [(F.col(score) >= t).cast("int") for t in ranked])
    per_step = scored.select(met.alias("met"), (F.col(label) == 1).cast("long").alias("y")).groupBy("met").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    table = scored.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ranked)], "step int, threshold double")
    total = per_step.agg(F.sum("pos").alias("support"))
    sums = table.join(F.broadcast(per_step), F.col("met") >= F.col("step"), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("n") - F.col("pos")), F.lit(0)).alias("fp"))  # one row a threshold on either side
    return with_scores(sums.join(F.broadcast(total)).withColumn("fn", F.col("support") - F.col("tp")))


def gate(scores: DataFrame, types: list[str] = DETERMINISTIC, precision: float = 1.0, recall: float = 0.99) -> DataFrame:
    """Types that miss the bounds or have no support."""
    wanted = scores.sparkSession.createDataFrame([(t,) for t in types], "type string")
    rows = wanted.join(scores, "type", "left")
    missed = F.coalesce(F.col("support"), F.lit(0)) == 0
    reasons = F.filter(F.array(F.when(missed, F.lit("no support")), F.when(~missed & (F.col("precision") < precision), F.lit("precision")), F.when(~missed & (F.col("recall") < recall), F.lit("recall"))), lambda r: r.isNotNull())
    return rows.select("type", F.array_join(reasons, ", ").alias("reasons")).filter("reasons <> ''")


def verdict(candidate: DataFrame, incumbent: DataFrame, eligible: bool = True, least_gain: float = 0.05, most_loss: float = 0.02, empty_fp: tuple[int, int] | None = None, most_empty_fp: int = 0) -> DataFrame:
    """One row: whether a candidate (type, f1) replaces an incumbent: macro F1 up by ``least_gain``, no type down by more than ``most_loss``.

    ``empty_fp``: false positives of both on documents without spans, which may rise by
    ``most_empty_fp``.
    """
    rows = candidate.select("type", F.col("f1").alias("c")).join(incumbent.select("type", F.col("f1").alias("i")), "type")
    loss = F.col("i") - F.col("c")
    sums = rows.agg(F.avg("c").alias("candidate_macro_f1"), F.avg("i").alias("incumbent_macro_f1"), F.array_sort(F.collect_list(F.when(loss > most_loss, F.col("type")))).alias("regressions"))
    gain = F.col("candidate_macro_f1") - F.col("incumbent_macro_f1")
    rise = F.lit(0 if empty_fp is None else empty_fp[0] - empty_fp[1])
    technical = (gain >= least_gain) & (F.size("regressions") == 0) & (rise <= most_empty_fp)
    reasons = F.filter(
        F.array(
            F.when(~F.lit(eligible), F.lit("not eligible")),
            F.when(gain < least_gain, F.lit("macro F1 gains too little")),
            F.when(F.size("regressions") > 0, F.lit("types regress")),
            F.when(rise > most_empty_fp, F.lit("more false positives on empty documents")),
            F.when(F.lit(eligible) & technical, F.lit("adoption rule is met")),
        ),
        lambda r: r.isNotNull(),
    )
    return sums.select("candidate_macro_f1", "incumbent_macro_f1", gain.alias("improvement"), "regressions", technical.alias("technical_pass"), (F.lit(eligible) & technical).alias("adopt"), reasons.alias("reasons"))


def best_run(runs: DataFrame, *order: str) -> DataFrame:
    """The run that ranks highest by the given columns."""
    return runs.groupBy().agg(F.max_by(F.struct(*runs.columns), F.struct(*order)).alias("r")).select("r.*")


def mandatory_macro(counts: DataFrame, types: list[str]) -> DataFrame:
    """Average F1 over ``types``, which must all have support: (macro_f1, missing)."""
    wanted = counts.sparkSession.createDataFrame([(t,) for t in types], "type string")
    rows = wanted.join(with_scores(counts), "type", "left")
    lacks = F.coalesce(F.col("support"), F.lit(0)) == 0
    missing = F.array_sort(F.collect_list(F.when(lacks, F.col("type"))))
    return rows.agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("f1"), missing.alias("missing")).select(F.when(F.size("missing") == 0, F.col("f1")).alias("macro_f1"), "missing")


def supported_types(counts: DataFrame) -> DataFrame:
    """Types with support, sorted (one row)."""
    return counts.agg(F.array_sort(F.collect_set(F.when(F.col("support") > 0, F.col("type")))).alias("types"))


def worst_regression(candidate: DataFrame, incumbent: DataFrame) -> DataFrame:
    """The largest loss of F1 of any type; 0 where none loses."""
    both = candidate.select("type", F.col("f1").alias("c")).join(incumbent.select("type", F.col("f1").alias("i")), "type")
    return both.agg(F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("i") - F.col("c")), F.lit(0.0))).alias("worst"))


def suites(gold: DataFrame, predicted: DataFrame, suite: str, types: list[str] | None = None, doc: str = "doc_id") -> DataFrame:
    """Strict counts and scores of each suite and type, all suites in one pass."""
    keep = lambda df: df if types is None else df.filter(F.col("type").isin(types))
    return with_scores(strict(keep(gold), keep(predicted), doc, [suite]))


# The steps, memory, precisions and device of a pilot run.
PILOT_STEPS, PILOT_BYTES, PILOT_AMP, PILOT_DEVICE = 500, 78 << 30, ("bf16", "fp16"), "A100"


def pilot_gate(runs: DataFrame, steps: int = PILOT_STEPS, most_bytes: int = PILOT_BYTES, device: str = PILOT_DEVICE) -> DataFrame:
    """Why each bounded pilot run may not be followed by a full one: (run, pass, reasons).

    The device is judged where runs name it (gpu_name).
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("not an open pilot", (F.col("run_kind") == "pilot") & ~F.col("complete")),
        ("eligible for adoption", ~F.col("adoption_eligible")),
        ("steps", (F.col("max_steps") == steps) & (F.col("optimizer_steps") == steps)),
        ("stop reason", F.col("stop_reason") == "max-steps"),
        ("mean loss", finite("mean_loss")),
        ("final loss", finite("final_loss")),
        ("memory", (F.col("peak_bytes") > 0) & (F.col("peak_bytes") < most_bytes)),
        ("precision", F.col("amp").isin(*PILOT_AMP)),
        ("development gate", F.col("development_gate_pass")),
    ]
    if "gpu_name" in runs.columns:
        rules.append(("device", F.contains(F.col("gpu_name"), F.lit(device))))
    reasons = F.filter(F.array(*[F.when(~sure(good), F.lit(name)) for name, good in rules]), lambda r: r.isNotNull())
    return runs.withColumn("reasons", reasons).select("run", (F.size("reasons") == 0).alias("pass"), "reasons")
