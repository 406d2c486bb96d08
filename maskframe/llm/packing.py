"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n tokens, its end id counted, is cut into n // longest pieces of the longest length
and one piece for each binary digit of the rest, longest first. Each piece is a sequence of its
own, of a power-of-two length, so that training takes batches of equal lengths (``batches``).
Sequences are numbered without gaps, lengths from the longest down: tasks number their own pieces
of each length, and running sums over one row a task and length say where each task begins.

Null and empty texts are the end id alone, one piece of one token. Rows that repeat are packed as
often as they occur; an empty table gives no pieces. Special tokens written in a text become their
ids. Of columns that stay, those named as a new one keep their name, and the new one gets a ``_``
at its end.
"""

from __future__ import annotations

import base64

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.llm._common import fresh_names, map_texts, materialize
from maskframe.llm.bpe import PATTERN, BytePairs
from maskframe.llm.token_counts import BLANKS

LONGEST = 1024
COLUMNS = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket_place"]
_PIECE = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("nth", T.LongType())])
_MADE = T.StructType([T.StructField("__tokens", T.LongType()), T.StructField("__part", T.LongType()), T.StructField("__pieces", T.ArrayType(_PIECE))])


class Encoder:
    """Token ids of a text under byte-pair ranks; texts that the rank encoder can't take go through ``BytePairs``."""

    def __init__(self, ranks_path: str, tokenizer_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = BytePairs(tokenizer_path)
        self.ranked = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.pairs.special)
        self.blanks = regex.compile(rf"\s{{{BLANKS}}}")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < BLANKS or self.blanks.search(text) is None:
            return self.ranked.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)
        return self.pairs.encode([text])[0].astype("<u4")


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def decompose(docs: DataFrame, ranks_path: str, tokenizer_path: str, text: str = "text", keep: list[str] | None = None, longest: int = LONGEST, end_id: int = 0) -> DataFrame:
    """The pieces of each document as they lie: columns that stay (doc_id), __tokens, __part, and start, length, ids (little-endian 32 bits), nth.

    nth numbers the pieces of a length within a task.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    state: list = []

    def work(texts):
        from pyspark import TaskContext

        if not state:
            state.extend([Encoder(ranks_path, tokenizer_path), {}])
        encode, numbers = state
        part = TaskContext.get().partitionId()
        totals, pieces = [], []
        for t in texts:
            ids = np.append(encode(t.decode()), np.uint32(end_id)).astype("<u4", copy=False)
            start, mine = 0, []
            for length in binary_lengths(len(ids), longest):
                nth = numbers.get(length, 0)
                numbers[length] = nth + 1
                mine.append((start, length, ids[start : start + length].tobytes(), nth))
                start += length
            totals.append(len(ids))
            pieces.append([dict(zip(_PIECE.names, p, strict=True)) for p in mine])
        return [totals, [part] * len(texts), pieces]

    kept = ["doc_id"] if keep is None else keep
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("__text"))
    made = map_texts(plain, "__text", work, _MADE, [f"c{i}" for i in range(len(kept))], limit=2 << 20)
    return made.select(*[f"c{i}" for i in range(len(kept))], "__tokens", "__part", F.inline("__pieces"))


def pack(docs: DataFrame, ranks_path: str, tokenizer_path: str, text: str = "text", keep: list[str] | None = None, longest: int = LONGEST, end_id: int = 0) -> DataFrame:
    """One row a piece: the columns that stay, start, length, ids, doc_tokens, sequence_id, offset (0), bucket_place (place among the sequences of its length)."""
    kept = ["doc_id"] if keep is None else keep
    pieces = materialize(decompose(docs, ranks_path, tokenizer_path, text, keep, longest, end_id), "pieces")
    counts = pieces.groupBy("__part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = materialize(counts.withColumn("in_length", F.coalesce(F.sum("n").over(before), F.lit(0))), "places")
    # One row a length: eleven rows at the default.
    lengths = tasks.groupBy("length").agg(F.sum("n").alias("n"))
    longer = Window.partitionBy(F.lit(0)).orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    first = lengths.select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("first"))
    placed = pieces.join(tasks.select("__part", "length", "in_length"), ["__part", "length"]).join(F.broadcast(first), "length")
    place = F.col("in_length") + F.col("nth")
    out = placed.select(*[f"c{i}" for i in range(len(kept))], "start", "length", "ids", "__tokens", (F.col("first") + place), F.lit(0).cast("long"), place)
    return out.toDF(*kept, *fresh_names(COLUMNS, kept))


def batches(packed: DataFrame, batch_tokens: int) -> DataFrame:
    """Adds ``batch``: sequences of one length that follow one another, ``batch_tokens`` in all (one sequence at least)."""
    return packed.withColumn("batch", F.floor(F.col("bucket_place") / F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))))


def write(packed: DataFrame, path: str) -> None:
    """Stores the sequences in one folder a length, for loaders that draw batches of equal lengths."""
    packed.write.partitionBy("length").option("compression", "zstd").mode("overwrite").parquet(path)
