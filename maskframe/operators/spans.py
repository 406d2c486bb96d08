"""Span operators over arrays of structs, in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<type:string,start:int,end:int,confidence:double,layer:string>"


def overlaps(a: Column, b: Column) -> Column:
    """Half-open spans share a place."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _order(*keys: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for key in reversed(keys):
            x, y = key(a), key(b)
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return compare


def greedy(spans: Column, *keys: Callable[[Column], Column], element: str = SPAN) -> Column:
    """Takes spans in the order of ``keys``; one that overlaps a taken span is lost."""
    ranked = F.array_sort(spans, _order(*keys))
    return F.aggregate(ranked, F.array().cast(f"array<{element}>"), lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(F.concat(kept, F.array(s))))


def resolve_overlaps(spans: Column) -> Column:
    """Deterministic layer first, then longest, most confident, leftmost, by type; in text order."""
    kept = greedy(
        spans,
        lambda s: F.when(s["layer"] == "deterministic", 0).otherwise(1),
        lambda s: s["start"] - s["end"],
        lambda s: -s["confidence"],
        lambda s: s["start"],
        lambda s: s["type"],
    )
    return F.array_sort(kept, _order(lambda s: s["start"], lambda s: s["end"], lambda s: s["type"]))


def best_entities(spans: Column) -> Column:
    """Model candidates by score, then narrowest, then leftmost, without overlaps."""
    return greedy(spans, lambda s: -s["confidence"], lambda s: s["end"] - s["start"], lambda s: s["start"], lambda s: s["type"])


def residual(text: Column, spans: Column) -> Column:
    """``text`` with its deterministic spans blanked, offsets unchanged."""
    known = F.filter(spans, lambda s: s["layer"] == "deterministic")
    return F.aggregate(known, text, lambda t, s: F.overlay(t, F.rpad(F.lit(""), s["end"] - s["start"], " "), s["start"] + 1, s["end"] - s["start"]))


#: Words that never need the entity model.
NEUTRAL_WORDS = ["and", "ile", "or", "the", "ve", "veya"]


def needs_model(text: Column, spans: Column) -> Column:
    """Whether what is left of a text holds a digit or a word that may be an entity."""
    rest = residual(text, spans)
    words = F.regexp_extract_all(rest, F.lit(r"(?U)[^\W\d_]+"), F.lit(0))
    return rest.rlike(r"\p{Nd}") | F.exists(words, lambda w: ~w.isin(NEUTRAL_WORDS))


def candidate_spans(n_tokens: Column, width: Column | int) -> Column:
    """All (first, last) token spans of ``width`` tokens at most."""
    width = F.lit(width) if isinstance(width, int) else width
    inner = lambda s: F.transform(F.sequence(s, F.least(n_tokens - 1, s + width - 1)), lambda e: F.struct(s.alias("first"), e.alias("last")))
    return F.when(n_tokens > 0, F.flatten(F.transform(F.sequence(F.lit(0), n_tokens - 1), inner))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def above_thresholds(spans: Column, thresholds: dict[str, float], default: float = 0.5) -> Column:
    """Spans at or above the threshold of their type."""
    known = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]) if thresholds else None
    least = lambda s: F.coalesce(F.element_at(known, s["type"]), F.lit(default)) if known is not None else F.lit(default)
    return F.filter(spans, lambda s: s["confidence"] >= least(s))


def query_threshold(thresholds: dict[str, float], default: float = 0.5) -> float:
    """What a model may be asked for so that no type loses a span."""
    return min([*thresholds.values(), default])


def model_threshold(thresholds: dict[str, float], scale: float, default: float = 0.5) -> float:
    """What a model whose scores are ``scale`` times as large is asked for."""
    return query_threshold(thresholds, default) * scale


def rescale(confidence: Column, scale: float) -> Column:
    return F.least(F.lit(1.0), confidence / F.lit(scale))


def unknown_types(spans: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Rows whose type is outside the closed taxonomy."""
    return spans.join(F.broadcast(taxonomy.select("type")), "type", "left_anti")
