"""Reversible masking: values become placeholders [LABEL_n], numbered by first appearance in a text."""

from __future__ import annotations

import secrets
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions import placeholders as P
from maskframe.functions.arrow import ROWS, add_columns
from maskframe.functions.placeholders import GRAMMAR, PLACEHOLDER
from maskframe.functions.recognizers import detect
from maskframe.taxonomy import DETERMINISTIC, LABELS

_TEXT = T.StringType()
MAPPING = T.StructType([T.StructField(n, k) for n, k in (("placeholder", _TEXT), ("type", _TEXT), ("start", T.IntegerType()), ("end", T.IntegerType()), ("value", _TEXT), ("confidence", T.DoubleType()), ("layer", _TEXT))])
RESULT = T.StructType([T.StructField("masked_text", _TEXT), T.StructField("mappings", T.ArrayType(MAPPING)), T.StructField("error_code", _TEXT)])
MAX_SPANS = 4096


def splice(text: str, spans: list[dict], suffix: str = "") -> tuple[str, list[dict]]:
    """Replaces ordered spans; equal values of a type share a placeholder, counters run per label."""
    known: dict[tuple[str, str], str] = {}
    counters: dict[str, int] = {}
    pieces, mappings, at = [], [], 0
    for s in spans:
        value = text[s["start"] : s["end"]]
        identity = (s["type"], unicodedata.normalize("NFC", value))
        if identity not in known:
            label = LABELS[s["type"]]
            counters[label] = counters.get(label, 0) + 1
            known[identity] = f"[{label}_{counters[label]}]{suffix}"
        pieces += [text[at : s["start"]], known[identity]]
        at = s["end"]
        mappings.append({"placeholder": known[identity], **s, "value": value})
    return "".join([*pieces, text[at:]]), mappings


def problem(text: str, spans: list[dict]) -> str | None:
    """Why spans cannot be spliced."""
    if len(spans) > MAX_SPANS:
        return "TOO_MANY_SPANS"
    ends = [0, *[s["end"] for s in spans]]
    if any(not before <= s["start"] < s["end"] <= len(text) for before, s in zip(ends, spans, strict=False)):
        return "BAD_SPANS"
    return "UNKNOWN_TYPE" if any(s["type"] not in LABELS for s in spans) else None


def _masked(text: str | None, spans, collision: str, suffix: str | None):
    if text is None:
        return {"masked_text": None, "mappings": [], "error_code": None}
    rows = spans or []
    hash_ = ""
    error = problem(text, rows)
    if error is None and PLACEHOLDER.search(text):
        if collision == "reject":
            error = "PLACEHOLDER_COLLISION"
        else:
            hash_ = f"#{suffix or secrets.token_hex(8)}"
    if error:
        return {"masked_text": None, "mappings": [], "error_code": error}
    masked, mappings = splice(text, rows, hash_)
    return {"masked_text": masked, "mappings": mappings, "error_code": None}


def mask(df: DataFrame, text: str = "text", spans: str = "spans", collision: str = "reject", seed: Column | None = None, include_values: bool = True) -> DataFrame:
    """``df`` with masked_text, mappings and error_code.

    A text that already holds a placeholder is an error, or with ``collision="prefix"`` gets
    placeholders with a 16-digit suffix: drawn at random, or for repeatable runs from ``seed``,
    which must be a secret.
    """
    suffix = F.lit(None).cast("string") if seed is None else F.substring(F.sha2(seed.cast("string"), 256), 1, 16)

    def work(texts, all_spans, suffixes):
        rows = [_masked(t, s, collision, x) for t, s, x in zip(texts, all_spans, suffixes, strict=True)]
        return [[r[c] for r in rows] for c in RESULT.names]

    made = add_columns(df, [F.col(text), F.col(spans), suffix], work, RESULT)
    return made if include_values else made.withColumn("mappings", F.transform("mappings", lambda m: m.withField("value", F.lit(None).cast("string"))))


def restore(masked: str | None, values: dict[str, str]) -> str | None:
    """Puts issued values back; unknown placeholders stay."""
    return None if masked is None else PLACEHOLDER.sub(lambda m: values.get(m[0], m[0]), masked)


def unmask(df: DataFrame, masked: str = "masked_text", mappings: str = "mappings", out: str = "text_restored") -> DataFrame:
    return df.withColumn(out, unmasker()(F.col(masked), F.map_from_entries(F.array_distinct(F.transform(mappings, lambda m: F.struct(m["placeholder"], m["value"]))))))


def unmasker():
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, values in batches:
            for at in range(0, len(texts), ROWS):
                yield pa.array([restore(t, dict(v) if v is not None else {}) for t, v in zip(texts.slice(at, ROWS).to_pylist(), values.slice(at, ROWS).to_pylist(), strict=True)], pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def masker():
    """Detection and masking of one text, for SQL: the same struct as ``mask`` adds, collisions included."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_masked(t, None if t is None else resolved(t), "reject", None) for t in texts], columns=RESULT.names)

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, RESULT)


def resolved(text: str) -> list[dict]:
    """Spans of one text without overlaps, in the order of ``spans.resolve_overlaps``."""
    kept: list[dict] = []
    for k, a, b, c in sorted(detect(text, frozenset(DETERMINISTIC)), key=lambda h: (h[1] - h[2], -h[3], h[1], h[0])):
        if all(b <= x["start"] or x["end"] <= a for x in kept):
            kept.append({"type": k, "start": a, "end": b, "confidence": c, "layer": "deterministic"})
    return sorted(kept, key=lambda x: x["start"])


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


_composed.__annotations__ = {"texts": pd.Series, "return": pd.Series}


def nfc(text: Column) -> Column:
    """Text in composed form; only what is not ASCII leaves the JVM."""
    return F.when(text.rlike("^\\p{ASCII}*$"), text).otherwise(F.pandas_udf(_composed, "string")(F.when(~text.rlike("^\\p{ASCII}*$"), text)))


def numbering(values: DataFrame, key: str) -> DataFrame:
    """Placeholder of each distinct value of a document: rows (key, type, label, start, value) in, ranks by first appearance out.

    Values that are equal once composed (NFC) are one.
    """
    first = values.withColumn("value", nfc(F.col("value"))).groupBy(key, "type", "label", "value").agg(F.min("start").alias("first_start"))
    rank = F.row_number().over(Window.partitionBy(key, "label").orderBy("first_start", "type", "value"))
    return first.withColumn("n", rank).withColumn("placeholder", P.spelled(F.col("label"), F.col("n")))


def has_placeholder(text: Column) -> Column:
    return text.rlike(GRAMMAR)


def budget_errors(items: DataFrame, request: str, item: str = "id", text: str = "text", max_items: int = 128, max_item: int = 65536, max_total: int = 262144) -> DataFrame:
    """Requests that break a budget, with the reasons."""
    sums = items.groupBy(request).agg(
        F.count("*").alias("n_items"),
        F.countDistinct(item).alias("n_ids"),
        F.max(F.length(text)).alias("longest"),
        F.sum(F.length(text)).alias("total"),
    )
    reasons = F.filter(
        F.array(
            F.when(F.col("n_items") > max_items, F.lit("too many items")),
            F.when(F.col("n_ids") < F.col("n_items"), F.lit("repeated ids")),
            F.when(F.col("longest") > max_item, F.lit("item too long")),
            F.when(F.col("total") > max_total, F.lit("request too long")),
        ),
        lambda r: r.isNotNull(),
    )
    return sums.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
