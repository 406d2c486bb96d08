"""The driver tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.taxonomy import TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for passes that cost far more than moving the rows.

    Only a table of fewer file splits than cores is dealt out anew; larger ones, which is every
    table at scale, are read as they lie and shuffle nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit records (seq, ts, kind, actor, entities, k)."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "click", "MASK_APPLIED").when(F.col("event_type") == "error", "REQUEST_BLOCKED").when(F.col("event_type") == "purchase", "VAULT_RESOLVE").when(F.col("event_type") == "signup", "POLICY_CHANGED").otherwise("ANCHOR")
    types = F.array(*[F.lit(t) for t in TYPES])
    entity = F.struct(F.element_at(types, F.pmod(k, F.lit(len(TYPES))) + 1).alias("type"), F.lit("mask").alias("action"), k.alias("count"))
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), "ts", kind.alias("kind"), F.col("user_id").cast("string").alias("actor"), F.array(entity).alias("entities"), k.alias("k"))


_TYPES = ", ".join(f"'{t}'" for t in TYPES)

#: The same log in SQL, to start a WITH clause.
AUDIT_SQL = f"""log AS (
  SELECT event_id + 1 AS seq, ts, CAST(user_id AS VARCHAR) AS actor, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
    CASE event_type WHEN 'click' THEN 'MASK_APPLIED' WHEN 'error' THEN 'REQUEST_BLOCKED' WHEN 'purchase' THEN 'VAULT_RESOLVE' WHEN 'signup' THEN 'POLICY_CHANGED' ELSE 'ANCHOR' END AS kind,
    ([{_TYPES}])[CAST(json_extract(props, '$.k') AS INTEGER) % 24 + 1] AS type
  FROM events
)"""
