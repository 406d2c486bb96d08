"""One query for each operator, over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm import bpe, classifier, conversations, decontaminate, hard_negatives, ngram_lm, packing, pseudonyms, quality_rules, shards, simhash, suffix_dedup, token_counts
from maskframe.llm._common import held_out, shared_dir
from maskframe.llm.sql import ORACLE_SQL as ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the registered queries; a real one comes from a secret store.
DEMO_KEY = "not-a-secret"
ARRIVALS = 5


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with its personal data replaced, and how many values that were."""
    return pseudonyms.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY, count="n_replaced")


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of each text under single words and under the backoff automaton."""
    held = held_out(F.col("doc_id"), 5, 1)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = ngram_lm.scores(docs, ~held)
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, truncated totals and quantiles at every context limit, under a byte-level vocabulary."""
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.limits(token_counts.histogram(token_counts.lengths(_table(spark, sf_dir, "documents"), *paths)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose fingerprints over four-word shingles differ in four bits at most."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 200-byte strings that repeat anywhere leave of each text."""
    return suffix_dedup.repeated(_table(spark, sf_dir, "documents"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after they came in as several arrivals: what the last manifest's shards hold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.pmod("doc_id", F.lit(ARRIVALS)), F.lit(0)).cast("int").alias("arrival"))
    table = shards.ShardTable(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    for i in range(ARRIVALS):
        table.append(docs.filter(F.col("arrival") == i))
    table.vacuum()
    return table.read().select("doc_id", "arrival", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of each text, learnt from three labels in four."""
    held = held_out(F.col("doc_id"), 4, 2)
    rows = classifier.quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), ~held)
    return rows.select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's token ids and of what they decode to."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text inside windows of benchmark items."""
    rows = decontaminate.mark(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit, n_items = F.size("hit_words").cast("long"), F.size("items").cast("long")
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of each text under policy v1."""
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = quality_rules.passes(F.col("failed"), "base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), quality_rules.passes(F.col("failed"), "v1").alias("kept"), "failed")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence of its own."""
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), *paths)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket_place")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of other labels for each anchor and positive, under labels that are wrong for an id in seven."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each damaged conversation, and the cheapest repair."""
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_pseudonyms, op2_ngram_lm, op3_token_counts, op4_simhash, op5_suffix_dedup, op6_shards, op7_quality_classifier, op8_bpe, op9_decontaminate, op10_quality_rules, op11_packing, op12_hard_negatives, op13_conversation_repair)}
