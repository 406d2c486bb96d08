"""The corpus pipeline: quality rules, near-duplicates, decontamination, pseudonyms, byte pairs.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next one's ``docs``; all but the last keep the columns of ``docs``. Null columns,
empty texts, repeated rows, empty tables and foreign columns pass through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm import bpe, decontaminate, pseudonyms, quality_rules, similar
from maskframe.llm._common import materialize, shared_dir

POLICY = "v1"
#: The key of the registered pipeline; a real one comes from a secret store.
KEY = "not-a-secret"
#: Near-duplicates: five words, a Jaccard similarity of 0.8. Candidates: bands of least hashes, then 256 bits, of which such texts differ in about 39, and a margin of five and a half standard errors.
WORDS, LANES, RADIUS, LEAST = 5, 4, 72, 0.8
VOCABULARY = "byte_bpe_50k.json"


def _plain(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with columns c0, c1 and so on, which clash with no operator's, and the name of its text."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index('text')}"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the rule policy."""
    plain, text = _plain(docs)
    rows = quality_rules.ledger(plain, text)
    return rows.filter(quality_rules.passes(F.col("failed"), POLICY)).select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, joined by pairs of LEAST similarity or more.

    Rows group by their texts, whatever their ids: the row with the smallest doc_id stays, rows
    without one only where no other has one, and of equal ones the first. Texts without words,
    null ones too, are one group.
    """
    plain, text = _plain(docs)
    rows = materialize(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    marks = similar.near_duplicates(rows, "row", doc_id=f"c{docs.columns.index('doc_id')}", text=text, words=WORDS, radius=RADIUS, lanes=LANES, least=LEAST)
    stay = marks.select(F.col("component").alias("row")).distinct()
    return rows.join(stay, "row", "left_semi").select(*plain.columns).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold no window of a benchmark item."""
    plain, text = _plain(docs)
    marked = decontaminate.mark(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=text)
    return marked.filter(F.size("hit_words") == 0).select(*plain.columns).toDF(*docs.columns)


def pseudonymized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by keyed pseudonyms."""
    plain, text = _plain(docs)
    return pseudonyms.pseudonymize(plain, KEY, text).toDF(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded text."""
    return bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pseudonyms", pseudonymized),
    ("byte pairs", encoded),
]

#: Fingerprints and byte pairs are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
