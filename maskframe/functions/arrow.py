"""Passes over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: Rows that are worked on at once: what Python holds of a batch does not grow with the batch.
ROWS = 256


def lists(rows: list[list[tuple] | None], kind: pa.StructType) -> pa.ListArray:
    """Lists of tuples as an array of structs; None gives null."""
    flat = [x for row in rows if row is not None for x in row]
    columns = list(zip(*flat, strict=True)) if flat else [()] * kind.num_fields
    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    ends = np.cumsum([0, *(len(row or ()) for row in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([*(row is None for row in rows), False])), items)


def add_columns(df: DataFrame, inputs: list[Column], work: Callable[..., list[list]], new: T.StructType) -> DataFrame:
    """``df`` with the columns ``new`` that ``work`` makes from lists of the input values; any column name is allowed."""
    n = len(df.columns)
    rows = df.select("*", *[x.alias(f"__in{i}") for i, x in enumerate(inputs)]).toDF(*[f"c{i}" for i in range(n + len(inputs))])
    out = T.StructType(rows.schema.fields[:n] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new.fields)])
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            made = work(*[c.to_pylist() for c in batch.columns[n:]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(c, k) for c, k in zip(made, kinds, strict=True)]], names=out.names)

    return rows.mapInArrow(run, out).toDF(*df.columns, *new.names)


def walked(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` for a pass that walks each key's rows in order: all of a key in one task.

    Spark leaves out a shuffle by the very columns that a join below has dealt by. Should that join
    then become a broadcast, its rows are read as they lie, and a key's rows are in several tasks.
    No join deals by the hash of the key, so this shuffle stays.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)
