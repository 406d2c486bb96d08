"""A quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of a text (shares of symbols, capitals, repeated lines and windows, lengths) are
standardised and mapped to random Fourier features, whose inner products approximate a Gaussian
kernel. Each partition sums its part of the normal equations, one fold of the training rows
apart from another; a few fixed-size matrices reach the driver, which solves for the ridge
weights. Scores of each fold under the weights of the others, in fixed bins, are calibrated to
shares of label 1 by pooling adjacent violators.

Null and empty texts have statistics of zero and get a score like any other. Ids that occur
more than once in the labels count once for each label; null labels are skipped. Without
labels every score is 0.5. Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.llm._common import map_texts, materialize
from maskframe.llm.quality_rules import MEASURES, measure

FEATURES = 192
FOLDS = 4
WIDTH = 2.5
RIDGE = 1e-3
BINS = 1000
_PUNCTUATION, _DIGITS = b".,;:?-()'\"", b"0123456789"


def statistics(text: bytes) -> list[float]:
    m = dict(zip(MEASURES, measure(text), strict=True))
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    count = lambda letters: len(text) - len(text.translate(None, letters))
    return [
        np.log1p(len(words)),
        np.log1p(m["word_chars"] / n),
        np.log1p(max(map(len, words), default=0)),
        m["n_symbols"] / n,
        m["n_dup_lines"] / max(1, m["n_lines"]),
        m["n_repeat_words"] / n,
        m["n_upper"] / max(1, m["n_letters"]),
        m["n_shouts"] / n,
        text.count(b"|") / n,
        m["n_echoes"] / n,
        len(set(words)) / n,
        count(_DIGITS) / size,
        count(_PUNCTUATION) / size,
        np.log1p(m["n_lines"]),
        m["n_letters"] / size,
    ]


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and statistics ``x`` of each text."""
    return map_texts(docs, text, lambda texts: [[statistics(t) for t in texts]], T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]), [doc_id])


class Model:
    """Standardisation, random directions, weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, scale
        self.direction = draw.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)) / 2)
        self.phase = draw.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.at, self.share = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[np.sqrt(2 / len(self.phase)) * np.cos(z @ self.direction + self.phase), np.ones(len(x))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.at, self.share)


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators over sorted places; returns block centres and their shares of ones."""
    blocks: list[list[float]] = []
    for a, k, s in zip(at, n, ones, strict=True):
        blocks.append([a * k, k, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(rows: DataFrame, label: str = "label", features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = 7) -> Model:
    """A model from rows of statistics ``x``, 0/1 labels and a fold number ``fold``."""
    size = rows.select(F.size("x").alias("n")).limit(1).collect()
    k = size[0].n if size else len(statistics(b""))
    got = rows.agg(F.count("*").alias("n"), *[f(F.get("x", F.lit(i))).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not got.n:
        return Model(np.zeros(k), np.ones(k), features, width, seed)
    mean = np.array([got[f"m{i}"] for i in range(k)])
    model = Model(mean, np.array([got[f"s{i}"] or 1.0 for i in range(k)]), features, width, seed)

    def sums(batches):
        total = np.zeros((FOLDS, features + 1, features + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column("x")))
                y, fold = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64), batch.column("fold").to_numpy()
                for f in np.unique(fold):
                    a = z[fold == f]
                    total[f] += a.T @ np.c_[a, y[fold == f]]
        if total.any():
            at = np.arange(FOLDS * (features + 1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([x.tobytes() for x in total.reshape(len(at), -1)], pa.binary())], names=["at", "v"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, v in zip(batch.column("at").to_pylist(), batch.column("v").to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["at", "v"])

    plain = rows.select("x", F.col(label).alias("label"), "fold")
    summed = plain.mapInArrow(sums, "at long, v binary").repartition(8, "at").mapInArrow(add, "at long, v binary").collect()  # (features + 1) * folds rows
    normal = np.zeros((FOLDS * (features + 1), features + 2))
    for r in summed:
        normal[r.at] = np.frombuffer(r.v)
    normal = normal.reshape(FOLDS, features + 1, features + 2)

    def solve(m):
        n = m[-1, -2]
        return np.linalg.solve(m[:, :-1] + ridge * max(1.0, n) * np.eye(features + 1) * np.r_[np.ones(features), 1e-9], m[:, -1])

    whole = normal.sum(axis=0)
    model.weights = solve(whole)
    others = np.array([solve(whole - m) if (whole - m)[-1, -2] else model.weights for m in normal])

    def bins(batches):
        n, ones = np.zeros(2 * BINS + 1), np.zeros(2 * BINS + 1)
        for batch in batches:
            if batch.num_rows:
                z, fold = model.features(_matrix(batch.column("x"))), batch.column("fold").to_numpy()
                at = np.clip(np.rint(((z * others[fold]).sum(axis=1) + 0.5) * BINS), 0, 2 * BINS).astype(np.int64)
                n += np.bincount(at, minlength=len(n))
                ones += np.bincount(at, weights=batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64), minlength=len(n))
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(n[full], pa.float64()), pa.array(ones[full], pa.float64())], names=["at", "n", "ones"])

    curve = plain.mapInArrow(bins, "at long, n double, ones double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toPandas().sort_values("at")  # a row a bin
    # Half a row of either label at the ends keeps shares off 0 and 1 where rows are few.
    model.at, model.share = isotonic(np.r_[0, curve["at"], 2 * BINS] / BINS - 0.5, np.r_[1, curve["n"], 1], np.r_[0.0, curve["ones"], 1.0])
    return model


def quality(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """id, score (0 to 1) and predicted (score >= threshold) of each text; ``learn`` (over the id) says which labels may be seen."""
    stats = materialize(describe(docs, doc_id, text), "statistics")
    seen = labels.filter(learn & F.col(label).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("label"))
    fold = F.pmod(F.xxhash64("__id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = materialize(stats.withColumnRenamed(doc_id, "__id").join(seen, "__id").select("x", "label", fold), "labelled")
    model = fit(rows)
    id_type = dict(docs.dtypes)[doc_id]

    def score(batches):
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, len(model.mean)))
            s = np.clip(model.score(x), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[doc_id, "score", "predicted"])

    return stats.select(doc_id, "x").mapInArrow(score, f"`{doc_id}` {id_type}, score double, predicted int")
