"""Means of all spans of a text's token vectors, by prefix sums.

Vectors of a text are added up once; the sum of any span is then the difference of two rows, so every
span up to a width costs the same. Scores of a span are the products of its mean with each label's
vector; the best spans that do not overlap stay (``spans.best_entities`` order: score, then narrower,
then earlier).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPANS = "array<struct<first:int,last:int,label:string,score:double>>"


def span_means(vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, mean) of every span of 1 to ``width`` tokens, last inclusive."""
    n = len(vectors)
    sums = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0, dtype=np.float64)])
    size = np.arange(1, min(width, n) + 1)
    first = np.concatenate([np.arange(n - w + 1) for w in size]) if n else np.zeros(0, np.int64)
    wide = np.repeat(size, n - size + 1) if n else np.zeros(0, np.int64)
    return first, first + wide - 1, (sums[first + wide] - sums[first]) / wide[:, None]


def best_spans(first: np.ndarray, last: np.ndarray, scores: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
    """The spans that stay, best first taken: (first, last, label, score)."""
    label = scores.argmax(1) if scores.size else np.zeros(0, np.int64)
    best = scores.max(1) if scores.size else np.zeros(0)
    order = np.lexsort((first, last - first, -best))
    taken = np.zeros(int(last.max()) + 1 if len(last) else 0, dtype=bool)
    out = []
    for i in order:
        if best[i] < least:
            break
        if not taken[first[i] : last[i] + 1].any():
            taken[first[i] : last[i] + 1] = True
            out.append((int(first[i]), int(last[i]), int(label[i]), float(best[i])))
    return sorted(out)


def scored(rows: DataFrame, vectors: str, labels: dict[str, list[float]], width: int, least: float, out: str = "spans") -> DataFrame:
    """``rows`` with the spans of their token vectors (an array of arrays) that score ``least`` or more. Null or empty vectors give none."""
    names = list(labels)
    table = np.array([labels[n] for n in names], dtype=np.float64)
    at = rows.columns.index(vectors)
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields], f"made {SPANS}"])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("label", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for tokens in batch.column(at).to_pylist():
                x = np.array([t for t in tokens or [] if t is not None], dtype=np.float64)
                if not len(x):
                    made.append([])
                    continue
                first, last, mean = span_means(x, width)
                made.append([{"first": a, "last": b, "label": names[k], "score": s} for a, b, k, s in best_spans(first, last, mean @ table.T, least)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*batch.schema.names, "made"])

    return plain.mapInArrow(run, schema).toDF(*rows.columns, out)
