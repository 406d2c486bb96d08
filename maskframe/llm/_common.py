"""What the operators share: the shared scratch folder, Arrow passes over documents, safe joins.

Text conventions: a null text counts as empty; words are runs of characters other than
ASCII white space, which is what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Upper to lower case for the 26 ASCII letters, on bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text that an Arrow pass works on at once.
CHUNK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session in one process (tests) gets a temporary folder; a cluster has no
    folder of that kind, so there it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, and lost executors cost no recomputation."""
    return materialize_at(df, label)[0]


def materialize_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``materialize``, and the folder, for callers that remove it once nothing reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``materialize_at``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null gives b''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts pass ``limit`` bytes; a longer single text stands alone."""
    for batch in batches:
        sizes = np.array([x or 0 for x in pa.compute.binary_length(batch.column(text)).to_pylist()], dtype=np.int64)
        start = total = 0
        for i, n in enumerate(sizes):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(df: DataFrame, text: str, work: Callable, new: T.StructType, keep: list[str] | None = None, limit: int = CHUNK_BYTES) -> DataFrame:
    """Adds columns made from the texts, a chunk at a time: ``work(list of bytes) -> list of columns``.

    ``keep`` names the columns that stay (all by default). New names must not clash; callers
    use a ``__`` prefix where they keep foreign columns.
    """
    source = df if keep is None else df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    at = source.columns.index(text)
    stay = [i for i, c in enumerate(source.columns) if keep is None or c != text or text in keep]
    plain = source.toDF(*[f"c{i}" for i in range(len(source.columns))])  # any name may hold a dot
    out = T.StructType([plain.schema.fields[i] for i in stay] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new.fields)])
    arrow = [_arrow_type(f.dataType) for f in new.fields]

    def run(batches):
        for batch in chunks(batches, f"c{at}", limit):
            columns = work(texts_of(batch.column(at)))
            made = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], *made], names=out.names)

    return plain.mapInArrow(run, out).toDF(*[source.columns[i] for i in stay], *new.names)


def fresh_names(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with as many ``_`` at its end as keep it apart from ``taken`` (letter case does not count)."""
    seen = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32(doc_id as text) mod ``mod`` is ``rest``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def crc_of(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int | None = None, share: int = 1000, how: str = "left") -> DataFrame:
    """Equi-join with ``right`` (one row for each key; ``weight``: rows of that key on the left) that no hot key can skew.

    Keys with over 1/share of all the weight (``total``, if known) are fewer than ``share``, so
    those are broadcast; the rest are joined by shuffle. ``weight`` is dropped.
    """
    if total is None:
        total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.filter(F.col(weight) * share > total)
    cold = right.filter(F.col(weight) * share <= total).drop(weight)
    marked = left.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")
    a = marked.filter(F.col("__hot")).drop("__hot").join(F.broadcast(hot.drop(weight)), key, "inner")
    b = marked.filter(F.col("__hot").isNull()).drop("__hot").join(cold, key, how)
    return a.unionByName(b)
