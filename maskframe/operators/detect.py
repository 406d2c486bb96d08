"""Detection: one Arrow pass finds all deterministic entities; the rest stays in the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions import recognizers
from maskframe.functions.arrow import ROWS, lists
from maskframe.operators import spans as S
from maskframe.taxonomy import DETERMINISTIC, LAYERS, TYPES

SPANS = f"array<{S.SPAN}>"
#: Every recognizer needs one of these; texts without them never leave the JVM.
PREFILTER = r"\p{Nd}|@|BEGIN|eyJ|sk-"


_TOKEN = pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SPAN = pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("layer", pa.string())])


def _finder(types: frozenset[str], alone: bool = False) -> Callable[[Column], Column]:
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            for at in range(0, len(batch), ROWS):
                yield lists([[] if t is None else [(*h, "deterministic") for h in recognizers.detect(t, types, alone)] for t in batch.slice(at, ROWS).to_pylist()], _SPAN)

    find.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, SPANS)


def candidates(text: Column, types: list[str] | None = None, alone: bool = False) -> Column:
    """All hits of the recognizers, overlapping ones too; with ``alone``, cards and phones only where they stand alone."""
    # Marked as not deterministic, so that no filter drawn from it makes the optimizer run it twice.
    return _finder(frozenset(types or DETERMINISTIC), alone).asNondeterministic()(F.when(text.rlike(PREFILTER), text))


def analyze(df: DataFrame, text: str = "text", types: list[str] | None = None, model: Callable[[DataFrame], DataFrame] | None = None, thresholds: dict[str, float] | None = None, out: str = "spans") -> DataFrame:
    """``df`` with the resolved spans of its texts.

    ``model`` adds a column ``model_spans`` to rows whose column ``text`` is null where no model is
    needed, and must keep the rows and their other columns. A null text has no spans. Columns of
    any name stay, but for one named like ``out``.
    """
    at = df.columns.index(text)
    names = [f"c{i}" for i in range(len(df.columns))]
    stay = [(n, c) for n, c in zip(names, df.columns, strict=True) if c != out]
    kept, titles = [n for n, _ in stay], [c for _, c in stay]
    found = df.toDF(*names).withColumn("hits", candidates(F.col(names[at]), types))
    if model is None:
        return found.select(*kept, S.resolve_overlaps(F.col("hits"))).toDF(*titles, out)
    # One pass: the model is asked for the texts that need it and gets nulls for the others.
    needed = F.coalesce(S.needs_model(F.col(names[at]), F.col("hits")), F.lit(False))
    asked = model(found.withColumn("text", F.when(needed, F.col(names[at]))))
    spans = S.above_thresholds(F.coalesce("model_spans", F.array().cast(SPANS)), thresholds or {})
    spans = F.when(needed, spans).otherwise(F.array().cast(SPANS))
    # The taxonomy is closed: a type from outside is an error of the model and no row gets past it.
    known = F.forall("model_spans", lambda s: s["type"].isin(TYPES))
    both = asked.withColumn("model_spans", spans)
    both = both.withColumn("model_spans", F.when(known, F.col("model_spans")).otherwise(F.raise_error(F.lit("the model gave an unknown type")).cast(SPANS)))
    return both.select(*kept, S.resolve_overlaps(F.concat("hits", "model_spans"))).toDF(*titles, out)


def lexicon_model(words: dict[str, str], text: str = "text", confidence: float = 0.9) -> Callable[[DataFrame], DataFrame]:
    """A stand-in entity model that knows a few words; shows the contract of a real one."""
    import re

    pattern = re.compile("|".join(rf"\b{re.escape(w)}\b" for w in sorted(words, key=len, reverse=True))) if words else None

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[] if t is None or pattern is None else [{"type": words[m[0]], "start": m.start(), "end": m.end(), "confidence": confidence, "layer": "ner"} for m in pattern.finditer(t)] for t in batch], dtype=object)

    predict.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    run = F.pandas_udf(predict, SPANS)
    return lambda df: df.withColumn("model_spans", run(F.col(text)))


_LOADED: dict = {}


def _load(load: Callable, artifacts: tuple[tuple[str, int, str], ...]):
    """A model whose files (path, size, SHA-256) are what they should be, loaded once in a process."""
    if artifacts not in _LOADED:
        for path, size, digest in artifacts:
            with open(path, "rb") as f:
                found = hashlib.file_digest(f, "sha256").hexdigest()
                if f.tell() != size or found != digest:
                    raise ValueError(f"{path} is not the pinned file")
        _LOADED.clear()  # one model a process
        _LOADED[artifacts] = load(*[a[0] for a in artifacts])
    return _LOADED[artifacts]


def loaded_model(load: Callable, artifacts: list[tuple[str, int, str]], batch: int = 32) -> Callable[[DataFrame], DataFrame]:
    """A model from pinned files as ``analyze`` takes it.

    ``load(*paths)`` gives a function from a list of texts to a list of spans each: (type, start, end,
    confidence). A worker process checks and loads the files once. Of the texts of an Arrow batch
    each different one is scored once, in groups of ``batch`` texts of like length; null texts are
    not scored. Paths must be readable on every executor.
    """
    pinned = tuple(tuple(a) for a in artifacts)

    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _load(load, pinned)
        for part in parts:
            texts = sorted({t for t in part if t is not None}, key=lambda t: (len(t), t))
            found: dict[str, list] = {}
            for i in range(0, len(texts), batch):
                group = texts[i : i + batch]
                for t, spans in zip(group, model(group), strict=True):
                    found[t] = [{"type": k, "start": a, "end": b, "confidence": c, "layer": "ner"} for k, a, b, c in spans]
            yield pd.Series([found.get(t, []) for t in part], dtype=object)

    predict.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    run = F.pandas_udf(predict, SPANS).asNondeterministic()
    return lambda df: df.withColumn("model_spans", run(F.col("text")))


def disabled_model(df: DataFrame) -> DataFrame:
    return df.withColumn("model_spans", F.array().cast(SPANS))


def exploded(df: DataFrame, key: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """A row for each span, with its value."""
    rows = df.select(key, text, F.explode(spans).alias("s"))
    return rows.select(key, "s.*", F.substring(F.col(text), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


def tokens(text: Column) -> Column:
    """Words and marks with their offsets: array of (token, start, end)."""

    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            for at in range(0, len(batch), ROWS):
                yield lists([[] if t is None else [(m[0], m.start(), m.end()) for m in recognizers.TOKEN.finditer(t)] for t in batch.slice(at, ROWS).to_pylist()], _TOKEN)

    find.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, "array<struct<token:string,start:int,end:int>>").asNondeterministic()(text)


LANGUAGES = ("tr", "en")


def supported(language: Column) -> Column:
    """Whether the recognizers know a language; their rules are the same for all of these."""
    return F.coalesce(F.lower(language).isin(*LANGUAGES), F.lit(False))


def decode_predictions(predictions: Column, labels: dict[str, str]) -> Column:
    """Spans of a model's raw output (label, start, end, score) under our types; labels it has no type for go.

    A type outside the entity model's part of the taxonomy, an empty span or a score outside 0 to 1
    is an error of the model.
    """
    bad = sorted(t for t in labels.values() if t not in LAYERS or LAYERS[t] != "ner")
    if bad:
        raise ValueError(f"labels stand for types that no entity model finds: {', '.join(bad)}")
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    named = F.filter(predictions, lambda p: F.element_at(known, p["label"]).isNotNull())
    good = F.forall(named, lambda p: F.coalesce((p["start"] >= 0) & (p["start"] < p["end"]) & p["score"].between(0, 1), F.lit(False)))
    span = F.transform(named, lambda p: F.struct(F.element_at(known, p["label"]).alias("type"), p["start"].cast("int").alias("start"), p["end"].cast("int").alias("end"), p["score"].cast("double").alias("confidence"), F.lit("ner").alias("layer")))
    return F.when(good, span).otherwise(F.raise_error(F.lit("the model gave an invalid span")).cast(SPANS))


class PiiSpans:
    """SQL table function: a row for each resolved span of a text."""

    def eval(self, text: str):
        from maskframe.operators.mask import resolved

        for s in resolved(text) if text is not None else []:
            yield s["type"], s["start"], s["end"], s["confidence"], s["layer"], text[s["start"] : s["end"]]


def register(spark) -> None:
    """SQL functions pii_analyze(text), pii_mask(text), pii_unmask(masked, values), and the table function pii_spans(text).

    ``pii_mask`` returns masked_text, mappings and error_code; map_from_entries of placeholder and
    value of the mappings is what ``pii_unmask`` takes.
    """
    from maskframe.operators import mask

    spark.udtf.register("pii_spans", F.udtf(PiiSpans, returnType="type string, start int, `end` int, confidence double, layer string, value string"))

    spark.udf.register("pii_analyze", _finder(frozenset(DETERMINISTIC)))
    spark.udf.register("pii_mask", mask.masker())
    spark.udf.register("pii_unmask", mask.unmasker())
