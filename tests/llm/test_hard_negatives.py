"""Hard negatives: every anchor against every row, in Python."""

import math
from collections import Counter

import numpy as np
import pytest

from maskframe.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=5):
    used = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, [max(-H.LIMIT, min(H.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v], label))
    out = Counter()
    for a, (i, v, label) in enumerate(used):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, same == label) for b, (j, w, same) in enumerate(used) if b != a)
        for s, none, j, _ in [r for r in scored if r[3]][:k]:
            hard = [r for r in scored if not r[3] and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            for rank, (t, empty, n, _) in enumerate(hard, 1):
                out[(i, None if none else j, rank, None if empty else n, -s, -t)] += 1
    return out


def mined(spark, rows, **how):
    df = H.mine(spark.createDataFrame(rows, SCHEMA), **how)
    return Counter(tuple(r) for r in df.collect())


def vectors(n, dim=8, seed=3, scale=1.0, copies=0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim)) + 3 * draw.normal(size=(4, dim))[draw.integers(0, 4, n)]
    rows = [(i, [float(v) for v in x[i] * scale], int(draw.integers(0, 3))) for i in range(n)]
    common = [float(v) for v in x[0] * scale]
    return rows + [(n + i, common, i % 2) for i in range(copies)]


@pytest.mark.parametrize("how", [{}, {"lists": 1}, {"lists": 40}])
def test_against_brute_force(spark, how):
    rows = vectors(500)
    assert mined(spark, rows, every=10, **how) == brute(rows, 10)


def test_common_vector_small_shelves(spark, monkeypatch):
    """A third of all rows are one vector; lists span shelves, shelves have copies."""
    monkeypatch.setattr(H, "SHELF", 16)
    monkeypatch.setattr(H, "ANCHORS_PER_COPY", 7)
    rows = vectors(200, copies=100)
    assert mined(spark, rows, every=5) == brute(rows, 5)


def test_ties_repeats_nulls(spark):
    draw = np.random.default_rng(5)
    rows = [(int(draw.integers(0, 60)) * 5, [float(v) for v in draw.integers(-1, 2, 3) / 256], int(draw.integers(0, 2))) for _ in range(150)]
    rows += rows[:20]
    rows += [(None, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0, 0.0], 1), (100, None, 1), (100, [1.0, None, 0.0], 1), (200, [1.0, float("nan"), 0.0], 1), (300, [float("inf")], 0), (100, [0.5, 0.5, 0.5], None), (100, [], 0), (200, [0.25], 1), (0, [0.0, 0.0, 0.0], 2)]
    padded = [(i, None if v is None else [*v, *[0.0] * (3 - len(v))], label) for i, v, label in rows]
    assert mined(spark, rows) == brute(padded)


def test_large_components(spark):
    rows = vectors(60, dim=4, scale=1e5) + [(600, [3e38, -3e38, 1.0, 0.0], 0), (700, [3e38, -3e38, 1.0, 0.0], 1)]
    assert mined(spark, rows, every=10) == brute(rows, 10)
    # Beyond what doubles hold exactly.
    assert mined(spark, vectors(300, dim=4, scale=4e6), every=10) == brute(vectors(300, dim=4, scale=4e6), 10)


def test_empty_and_foreign_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mine(empty).collect() == []
    lonely = spark.createDataFrame([(100, [1.0], 0), (101, [1.0], 0)], SCHEMA)
    assert H.mine(lonely).collect() == []
    rows = vectors(40)
    wide = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", score string, shelf int")
    assert Counter(tuple(r) for r in H.mine(wide, every=4).collect()) == brute(rows, 4)


def test_skips_lists_by_their_bounds(spark):
    """Well parted clusters: most lists lie strictly below the k-th score of an anchor."""
    draw = np.random.default_rng(9)
    centres = 20 * np.eye(12)
    rows = [(i, [float(v) for v in centres[i % 12] + 0.01 * draw.normal(size=12)], i % 2 + 2 * (i % 12)) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    at = H.index(df, "vec_id", "embedding", "label", H.F.col("vec_id") % 100 == 0, 6, 60)
    small = at.without_frame()
    anchors = H._matrix([r.v for r in at.entries.filter("n_anchors > 0").collect()], at.dim)
    low, high = small.bounds(anchors)
    exact = anchors @ H._matrix([r.v for r in at.entries.collect()], at.dim).T
    fifth = np.sort(exact, axis=1)[:, -6]
    assert (high < fifth[:, None]).mean() > 0.8
    assert mined(spark, rows, lists=60) == brute(rows)
