"""Exact selection of ranks by histograms that are refined until a cell is one number.

A round counts the values of the interval that holds a wanted rank in ``CELLS`` equal cells and keeps the
cell with the rank; intervals shrink some thousandfold a round, and a round gathers one row a cell,
whatever the number of values or of different ones. Cells are cut by the value itself, and a cell's own
least and greatest values become the next interval, so gaps cost no rounds and equal values end one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 4096
#: Rounds at most: each leaves the values of one cell of the last, and no interval of doubles has more than 2^64.
MOST_ROUNDS = 64


def ranked(rows: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values at some ranks (from 0) among all numbers of a column in order; nulls and NaN are left out."""
    plain = rows.select(F.col(f"`{value}`").cast("double").alias("v")).filter("v is not null and not isnan(v)")
    whole = plain.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if any(not 0 <= r < whole.n for r in ranks):
        raise ValueError(f"there are {whole.n} values")
    # Each open rank: an interval that holds it, and how many values lie below the interval.
    open_ = {r: (whole.low, whole.high, 0) for r in set(ranks)}
    done: dict[int, float] = {}
    for _ in range(MOST_ROUNDS):
        done |= {r: low for r, (low, high, _) in open_.items() if low == high}
        open_ = {r: x for r, x in open_.items() if r not in done}
        if not open_:
            return [done[r] for r in ranks]
        spans = sorted({(low, high) for low, high, _ in open_.values()})
        which = F.lit(None).cast("int")
        cell = F.lit(None).cast("int")
        for i, (low, high) in enumerate(spans):
            inside = F.col("v").between(low, high)
            # Halves first: the width of an interval may be beyond all doubles.
            share = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2)
            at = F.least(F.lit(CELLS - 1), F.floor(share * CELLS)).cast("int")
            # Where the width is too small to divide, the ends are apart still.
            at = F.when(F.isnan(share), F.when(F.col("v") > low, CELLS - 1).otherwise(0)).otherwise(at) if high / 2 - low / 2 > 0 else F.when(F.col("v") > low, 1).otherwise(0)
            which, cell = F.when(inside, i).otherwise(which), F.when(inside, at).otherwise(cell)
        counted = plain.select("v", which.alias("i"), cell.alias("c")).filter("i is not null").groupBy("i", "c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        cells: dict[int, list] = {}
        for row in counted.collect():  # CELLS rows for each open interval
            cells.setdefault(row.i, []).append((row.low, row.high, row.n))
        for r, (low, high, below) in list(open_.items()):
            for a, b, n in sorted(cells[spans.index((low, high))]):
                if r < below + n:
                    open_[r] = (a, b, below)
                    break
                below += n
    raise RuntimeError("intervals did not shrink")


def quantile(rows: DataFrame, value: str, q: float) -> float | None:
    """The quantile between the two neighbouring ranks, as ``percentile`` gives it; null without values."""
    n = rows.filter(F.col(f"`{value}`").isNotNull() & ~F.isnan(F.col(f"`{value}`").cast("double"))).count()
    if not n:
        return None
    place = q * (n - 1)
    low = int(place)
    a, b = ranked(rows, value, [low, min(low + 1, n - 1)])
    return a if a == b else a + (b - a) * (place - low)
