"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a text; the ledger keeps the measurements and one failure bit
a rule. A policy is a versioned mask: a text is rejected if its failure bits meet the mask. So
changing a policy, or asking what each rule costs (ablation), never reads the texts again.

Null and empty texts have no words and fail ``too_few_words``. Repeated rows are judged one by
one. The rules of v1 are for scripts that part words by blanks: a text without blanks is one long
word and fails ``too_few_words`` and ``word_length``. Existing columns stay.
A table with columns of the ledger's names needs a ``prefix``; without one it would have them twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.llm._common import map_texts

SYMBOLS = b"#*$%&|<>"
#: UTF-8 bytes that continue a code point.
CONTINUES = bytes(range(0x80, 0xC0))
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_echoes")

#: Rule name -> condition of failure over the measurements; a rule's bit is its place.
RULES = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "upper_case": "10 * n_upper > 4 * n_letters",
    "shouting": "10 * n_shouts > 3 * n_words",
    "echoed_words": "5 * n_echoes > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}
BASE = ("too_few_words", "repeated_windows")
#: Policy version -> the rules that reject.
POLICIES = {"base": BASE, "v1": tuple(RULES)}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that stand twice or more in the text.

    Windows are numbered exactly, without hashes, by doubling: a number for each pair of
    neighbouring halves.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == len(words):
        return 0
    half = 1
    while half < window:
        pair = ids[:-half] * (int(ids.max()) + 1) + ids[half:]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(counts) == len(pair):
            return 0
        half *= 2
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.nonzero(counts[ids] > 1)[0]
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + window, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (
        len(words),
        len(joined.translate(None, CONTINUES)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + lower,
        text.count(b"!"),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def ledger(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measurements and ``failed`` (long: bit i is set if rule i fails)."""
    schema = T.StructType([T.StructField(f"__{m}", T.LongType()) for m in MEASURES])

    def work(texts):
        rows = [measure(t) for t in texts]
        return list(zip(*rows, strict=True)) if rows else [[] for _ in MEASURES]

    out = map_texts(docs, text, work, schema)
    failed = F.lit(0).cast("long")
    for bit, rule in enumerate(RULES.values()):
        for m in MEASURES:
            rule = f" {rule} ".replace(f" {m} ", f" `__{m}` ")
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(1 << bit)).otherwise(0).cast("long"))
    out = out.withColumn("__failed", failed)
    return out.withColumnsRenamed({f"__{m}": f"{prefix}{m}" for m in (*MEASURES, "failed")})


def mask_of(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def passes(failed: Column, policy: str = "v1") -> Column:
    """Whether ledger bits pass a policy version."""
    return failed.bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, failed: str = "failed", policy: str = "v1") -> DataFrame:
    """One row a rule: texts that fail it, and those that it alone rejects (kept if the rule were dropped)."""
    mask = mask_of(POLICIES[policy])
    bits = rows.groupBy(F.col(failed).bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    per_rule = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in enumerate(RULES) if mask >> i & 1]
    return (
        bits.select("bits", "n", F.explode(F.array(*per_rule)).alias("r"))
        .groupBy("r.rule")
        .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"))
    )
