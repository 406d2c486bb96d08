"""Exact ranks, keyed permutations, span scores and whole-number draws against plain computations."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.operators import corpus, permute, select, spanscores


@pytest.mark.parametrize("values", [[1.0], [2.5] * 50, [float(i) for i in range(3000)], [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, -5e-324, 1.0, 1.0 + 2**-52], [math.inf, -math.inf, 3.0, 3.0, 1e300]])
def test_ranks(spark, values):
    rows = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double")
    want = sorted(values)
    ranks = sorted({0, len(want) - 1, len(want) // 2, len(want) // 3})
    assert select.ranked(rows, "v", ranks) == [want[r] for r in ranks]


def test_quantiles_and_edges(spark):
    draw = random.Random(1)
    values = [draw.gauss(0, 1) * 10 ** draw.randint(-20, 20) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert math.isclose(select.quantile(rows, "v", 0.95), float(np.quantile(values, 0.95)), rel_tol=1e-12)
    assert select.quantile(rows.limit(0), "v", 0.5) is None
    with pytest.raises(ValueError):
        select.ranked(rows, "v", [2000])


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_every_row_once(n):
    places = permute.permuted(np.arange(n), n, 7, 1)
    assert sorted(places) == list(range(n)) and (permute.permuted(places, n, 7, 1, back=True) == np.arange(n)).all()
    if n >= 1000:
        other = permute.permuted(np.arange(n), n, 7, 2)
        assert (other == places).mean() < 0.02 and abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.1


def test_numbers_of_large_tables_and_beyond():
    n = 10**12
    rows = np.array([0, 1, n - 1, 123_456_789_012])
    assert (permute.permuted(permute.permuted(rows, n, 3, 4), n, 3, 4, back=True) == rows).all()
    with pytest.raises(ValueError):
        permute.permuted(np.array([5]), 5, 1, 1)
    assert len(permute.permuted(np.array([], dtype=np.int64), 0, 1, 1)) == 0


def test_slices_are_computed_alone(spark):
    rows = spark.range(500).select(F.col("id").alias("row"), (F.col("id") * 3).alias("x"))
    whole = {r.place: r.x for r in permute.epoch(rows, "row", 500, 1, 9).collect()}
    part = permute.epoch_slice(rows, "row", 500, 1, 9, 100, 120).collect()
    assert {r.place: r.x for r in part} == {p: whole[p] for p in range(100, 120)} and part[0].x is not None
    assert permute.epoch_slice(rows, "row", 500, 1, 9, 490, 600).count() == 10 and permute.epoch_slice(rows, "row", 500, 1, 9, 5, 5).count() == 0


def test_span_means_and_best_spans(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(9, 5))
    first, last, mean = spanscores.span_means(x, 4)
    assert sorted(zip(first, last)) == [(a, b) for a in range(9) for b in range(a, min(9, a + 4))]
    assert all(np.allclose(m, x[a : b + 1].mean(0)) for a, b, m in zip(first, last, mean))
    labels = {"a": [1.0, 0, 0, 0, 0], "b": [0, 1.0, 0, 0, 0]}
    rows = spark.createDataFrame([(1, x.tolist()), (2, []), (3, None), (4, [[1.0] * 5])], "id int, spans array<array<double>>")
    got = {r.id: [(s["first"], s["last"], s["label"], round(s["score"], 9)) for s in r.found] for r in spanscores.scored(rows, "spans", labels, 4, 0.2, "found").collect()}
    table = np.array(list(labels.values()))
    left, want = sorted(((-(m @ table.T).max(), b - a, a, b, "ab"[(m @ table.T).argmax()]) for a, b, m in zip(first, last, mean))), []
    for score, _, a, b, label in left:
        if -score >= 0.2 and all(b < c or d < a for c, d, *_ in want):
            want.append((int(a), int(b), label, round(-score, 9)))
    assert got[1] == sorted(want) and got[2] == got[3] == [] and got[4] == [(0, 0, "a", 1.0)]


def test_each_point_falls_into_one_stretch(spark):
    rows = spark.createDataFrame([(i, w, {"m": i}) for i, w in enumerate([0.1] * 300 + [0.0, None, 1e-9, 3.7] + [1 / 3] * 100)] + [(5, 0.1, {"m": -1}), (5, 0.1, {"m": -1})], "id long, weight double, m map<string,int>")
    for most in (200_000, 37):
        got = corpus.draw(rows, 5000, "s", "id", most=most).collect()
        assert sorted(r.draw for r in got) == list(range(5000)) and got[0].m is not None
        count = Counter(r.id for r in got)
        assert not {300, 301, 302} & set(count) and count[303] > 100
    wide = spark.createDataFrame([(1, 1e6), (2, 1.0)], "id long, weight double")
    assert corpus.draw(wide, 200_000, "s", "id").count() == 200_000


def test_stretches_follow_the_order_of_keys_in_any_number_of_buckets(spark):
    rows = spark.createDataFrame([((i * 37) % 400, 1.0 + i % 3) for i in range(400)], "id long, weight double")
    one, many = (sorted((r.draw, r.id) for r in corpus.draw(rows, 300, "s", "id", most=most).collect()) for most in (200_000, 30))
    assert one == many
