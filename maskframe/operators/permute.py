"""Keyed permutations of row numbers: an epoch is a bijection of [0, n), read by place.

A Feistel network over the next even power of two permutes numbers of 2 k bits; a number that falls
beyond n is permuted again until it falls within (cycle walking), which keeps the map one to one. So
the place of any row, and the row at any place, are computed alone: an epoch needs no sort, a slice of
it no other slice, and a run that stopped goes on from its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


def _keys(seed: int, epoch: int) -> np.ndarray:
    digest = hashlib.shake_256(f"{seed}:{epoch}".encode()).digest(8 * ROUNDS)
    return np.frombuffer(digest, dtype="<u8")


def _mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = x + key
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, seed: int, epoch: int, back: bool = False) -> np.ndarray:
    """Where the numbers of [0, n) go, or with ``back`` where they come from."""
    x = np.asarray(numbers, dtype=np.uint64).copy()
    if len(x) and int(x.max()) >= n:
        raise ValueError("a number lies beyond the rows")
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _keys(seed, epoch)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for key in keys[::-1] if back else keys:
            left, right = (right ^ (_mixed(left, key) & mask), left) if back else (right, left ^ (_mixed(right, key) & mask))
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def place_of(row: Column, n: int, seed: int, epoch: int, back: bool = False) -> Column:
    """``permuted`` as a column."""

    def run(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in numbers:
            yield pd.Series(permuted(part.to_numpy(), n, seed, epoch, back))

    run.__annotations__ = {"numbers": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "bigint")(row.cast("bigint"))


def epoch(rows: DataFrame, row: str, n: int, seed: int, epoch: int) -> DataFrame:
    """``rows``, numbered from 0 to n - 1 in ``row``, with ``place``, each row's own in the epoch."""
    return rows.withColumn("place", place_of(F.col(row), n, seed, epoch))


def epoch_slice(rows: DataFrame, row: str, n: int, seed: int, epoch: int, first: int, last: int) -> DataFrame:
    """The rows at the places from ``first`` to before ``last``, with ``place``; only their numbers are looked up."""
    last = min(last, n)
    wanted = rows.sparkSession.range(first, max(first, last)).select(F.col("id").alias("place"), place_of(F.col("id"), n, seed, epoch, back=True).alias("__row"))
    return wanted.join(rows, F.col("__row") == F.col(row)).drop("__row")
