"""Streaming queries, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators import vault
from maskframe.plans.tables import table
from maskframe.sources.scratch import folder as _folder
from maskframe.streaming import jobs

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Everything a stream gives until its input ends."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("""SELECT conv_id || '/' || turn AS resp_id, left(text, length(text) // 2) || CASE WHEN turn % 3 = 2 THEN '[KISI_1]' ELSE 'Ayşe ' || conv_id END || substr(text, length(text) // 2 + 1) AS restored
FROM conversations WHERE text IS NOT NULL""")
def stream_reassembly(spark, sf_dir):
    """Turns with a placeholder in the middle, cut into chunks of seven characters and restored by the stream.

    All share the placeholder's name, every conversation is a session with a value of its own, and
    every third turn was issued no placeholder, so that it keeps what it has.
    """
    folder = _folder(spark)
    half = F.floor(F.length("text") / 2).cast("int")
    masked = F.concat(F.left("text", half), F.lit("[KISI_1]"), F.substring(F.col("text"), half + 1, F.length("text")))
    turns = table(spark, sf_dir, "conversations").filter("text is not null").select(F.concat_ws("/", "conv_id", "turn").alias("resp_id"), "conv_id", "turn", masked.alias("masked"))
    n = F.ceil(F.length("masked") / 7).cast("int")
    chunks = turns.select("resp_id", F.lit("content").alias("field_key"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), "masked")
    chunks = chunks.select("resp_id", "field_key", F.col("i").cast("long").alias("seq"), F.substring(F.col("masked"), F.col("i") * 7 + 1, F.lit(7)).alias("text"), F.lit("text").alias("fmt"), (F.col("i") == F.col("n") - 1).alias("terminal"))
    chunks.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(jobs.CHUNKS).parquet(f"{folder}/in")
    scope = [F.lit("tenant").alias("tenant_id"), F.col("conv_id").cast("string").alias("session_id"), F.lit("[KISI_1]").alias("placeholder")]
    held = turns.select(*scope, F.lit("PERSON").alias("type"), F.concat(F.lit("Ayşe "), F.col("conv_id").cast("string")).alias("value"), F.lit("2100-01-01").cast("timestamp").alias("expires_at")).distinct()
    issued = turns.filter("turn % 3 <> 2").select("resp_id", *scope)
    restored = drained(jobs.restore_stream(source, vault.authorised(issued, held, F.lit("2030-01-01").cast("timestamp")), idle_ms=None), folder)
    joined = restored.groupBy("resp_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("restored"))
    return joined.select("resp_id", "restored")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def audit_rollup_hourly(spark, sf_dir):
    """Event-time windows over the log; in batch here, the same operator runs on a stream."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    return jobs.audit_rollup(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")
