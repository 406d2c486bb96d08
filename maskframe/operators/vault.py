"""The value vault as tables: stable placeholders per scope, encrypted values, expiry and limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskframe.functions import placeholders as P
from maskframe.functions.arrow import walked
from maskframe.operators.mask import nfc

SCOPE = ["tenant_id", "session_id"]


def intern(vault: DataFrame, values: DataFrame, expires_at: Column, now: Column | None = None) -> DataFrame:
    """New vault rows for values (scope, type, label, value, first_seen) that the scope has not; same value, same placeholder.

    Values that are equal once composed (NFC) are one; what has expired by ``now`` is not known any
    more. Numbers go on after the largest of the scope and label, expired ones too, in the order of
    first_seen, so no placeholder that was ever given out gets another value. Past 99,999 they go on
    in blocks that the grammar can tell (``functions.placeholders``).
    """
    live = vault if now is None else vault.filter(F.col("expires_at") > now)
    known = live.select(*SCOPE, "type", nfc(F.col("value")).alias("value")).distinct()
    values = values.withColumn("value", nfc(F.col("value")))
    fresh = values.groupBy(*SCOPE, "type", "label", "value").agg(F.min("first_seen").alias("first_seen")).join(known, [*SCOPE, "type", "value"], "left_anti")
    last = counters(vault.select(*SCOPE, "placeholder"))
    n = F.row_number().over(Window.partitionBy(*SCOPE, "label").orderBy("first_seen", "type", "value")) + F.coalesce("last_n", F.lit(0))
    numbered = fresh.join(last, [*SCOPE, "label"], "left").withColumn("n", n)
    return numbered.select(*SCOPE, "type", "value", P.spelled(F.col("label"), F.col("n")).alias("placeholder"), expires_at.alias("expires_at"))


def allocate(vault: DataFrame, requests: DataFrame, order: str) -> DataFrame:
    """``requests`` (scope, placeholder) with ``given``: the placeholder asked for where it is free, else one past all that are known.

    Of several requests for one placeholder the first in ``order`` gets it. A suffix stays with its
    label; where its numbers are used up, and for what is no placeholder, ``given`` is null.
    """
    asked = F.col("placeholder")
    label = F.concat(P.label(asked), P.suffix(asked))
    taken = vault.select(*SCOPE, "placeholder", F.lit(True).alias("__taken")).distinct()
    rows = requests.join(taken, [*SCOPE, "placeholder"], "left").withColumn("__first", F.row_number().over(Window.partitionBy(*SCOPE, "placeholder").orderBy(order)) == 1)
    rows = rows.withColumns({"__free": F.col("__first") & F.col("__taken").isNull(), "__label": label})
    both = vault.select(*SCOPE, "placeholder").unionByName(requests.select(*SCOPE, "placeholder"))
    last = both.groupBy(*SCOPE, label.alias("__label")).agg(F.max(P.number(asked)).alias("__last"))
    n = F.row_number().over(Window.partitionBy(*SCOPE, "__label", "__free").orderBy(order)) + F.col("__last")
    moved = P.spelled(P.label(asked), n, P.suffix(asked))
    given = F.when(P.is_placeholder(asked), F.when(F.col("__free"), asked).otherwise(moved))
    return rows.join(last, [*SCOPE, "__label"]).withColumn("given", given).select(*requests.columns, "given")


def counters(placeholders: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The largest number of each label in a scope, read from placeholders."""
    keys = SCOPE if keys is None else keys
    given = F.col("placeholder")
    rows = placeholders.select(*keys, P.label(given).alias("label"), P.number(given).alias("n")).filter("n is not null")
    return rows.groupBy(*keys, "label").agg(F.max("n").alias("last_n"))


def upsert_counters(counters: DataFrame, seen: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counters (scope, label, last_n) after numbers were seen: one past the old one, or the largest seen if that is more."""
    keys = [*(SCOPE if keys is None else keys), "label"]
    both = counters.select(*keys, F.col("last_n").alias("old")).join(seen.groupBy(*keys).agg(F.max("last_n").alias("new")), keys, "full")
    return both.select(*keys, F.when(F.col("new").isNull(), F.col("old")).otherwise(F.greatest(F.col("old") + 1, F.col("new"))).alias("last_n"))


def seal(vault: DataFrame, key: Column, iv: Column, secret: str) -> tuple[DataFrame, DataFrame]:
    """Vault rows as they are stored, values encrypted and found again by their keyed digest, and one audit event for each scope."""
    from maskframe.operators.audit import fingerprint, keyed_hash

    aad = F.concat_ws("|", *SCOPE, "placeholder")
    digest = keyed_hash(secret, "maskframe-vault-value-v1")(F.concat_ws("\0", "type", nfc(F.col("value"))))
    stored = vault.select(*SCOPE, "placeholder", F.col("type").alias("entity_type"), digest.alias("value_hmac"), encrypt(F.col("value"), key, iv, aad).alias("sealed"), "expires_at")
    counts = vault.groupBy(*SCOPE, "type").agg(F.count("*").cast("int").alias("count"))
    events = counts.groupBy(*SCOPE).agg(F.array_sort(F.collect_list(F.struct("type", F.lit("mask").alias("action"), "count"))).alias("entities"))
    request = fingerprint(F.to_json("entities"), secret)
    return stored, events.select(F.lit("MASK_APPLIED").alias("kind"), F.concat(F.lit("api-key:"), "tenant_id").alias("actor"), "session_id", request.alias("request_sha256"), "entities")


def unseal(stored: DataFrame, key: Column) -> DataFrame:
    """Stored rows with their values; null where key or scope do not fit."""
    return stored.withColumn("value", decrypt(F.col("sealed"), key, F.concat_ws("|", *SCOPE, "placeholder"))).drop("sealed")


def base64url(data: Column) -> Column:
    """Base64 for names and addresses, without padding."""
    return F.translate(F.base64(data), "+/=\r\n", "-_")


def from_base64url(text: Column) -> Column:
    return F.unbase64(F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("=")))


def resolve(vault: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Values of placeholders (scope, placeholder) that have not expired; null where there is none."""
    return wanted.join(vault.filter(F.col("expires_at") > now).select(*SCOPE, "placeholder", "value", "type"), [*SCOPE, "placeholder"], "left")


def touch(vault: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """``vault`` with used_at set to ``now`` for the placeholders (scope, placeholder) that were resolved; expired rows stay as they are."""
    hit = used.select(*SCOPE, "placeholder", F.lit(True).alias("__hit")).distinct()
    fresh = F.col("__hit") & (F.col("expires_at") > now)
    return vault.join(hit, [*SCOPE, "placeholder"], "left").withColumn("used_at", F.when(fresh, F.greatest("used_at", now)).otherwise(F.col("used_at"))).drop("__hit")


def authorised(issued: DataFrame, vault: DataFrame, now: Column) -> DataFrame:
    """What each response may restore (resp_id, placeholder, value): placeholders issued to it (resp_id, scope, placeholder) that its scope still has."""
    return resolve(vault, issued.select("resp_id", *SCOPE, "placeholder").distinct(), now).filter("value is not null").select("resp_id", "placeholder", "value")


def sessions(vault: DataFrame, now: Column) -> DataFrame:
    """Sessions of each tenant with their live placeholders, without values."""
    return sweep(vault, now).groupBy(*SCOPE).agg(F.count("*").alias("placeholders"), F.max("expires_at").alias("expires_at"))


def by_digest(vault: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Placeholders of values that are known by their keyed digest alone (scope, type, value_hmac).

    Rows that carry their digest, as ``seal`` stores it, are not hashed again.
    """
    from maskframe.operators.audit import keyed_hash

    rows = vault if "value_hmac" in vault.columns else vault.withColumn("value_hmac", keyed_hash(key, "maskframe-vault-value-v1")(F.concat_ws("\0", "type", nfc(F.col("value")))))
    return wanted.join(rows.select(*SCOPE, "type", "value_hmac", "placeholder"), [*SCOPE, "type", "value_hmac"])


def within_capacity(windows: DataFrame, now: Column, most: int, opened: str = "opened_at", ends: str = "ends_at", key: str = "key") -> DataFrame:
    """Rate-limit windows that are kept: those still open, and of these the ``most`` that opened last."""
    return windows.filter(F.col(ends) > now).orderBy(F.desc(opened), F.desc(key)).limit(most)


def sweep(rows: DataFrame, now: Column) -> DataFrame:
    """What is left after expiry."""
    return rows.filter(F.col("expires_at") > now)


def evicted(rows: DataFrame, scope: list[str], used_at: str, tie: str, most: int) -> DataFrame:
    """Rows beyond the ``most`` most recently used ones of their scope."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc(used_at), F.desc(tie)))).filter(F.col("rank") > most)


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key: claims where the first writer wins, and DISTINCT ON."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def encrypt(value: Column, key: Column, iv: Column, aad: Column) -> Column:
    """AES-GCM under a data key, bound to its scope: nonce, ciphertext and tag."""
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad)


def decrypt(sealed: Column, key: Column, aad: Column) -> Column:
    """Null where key or scope do not fit."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")


def rate_limited(hits: DataFrame, key: str, at: str, tie: str, limit: int, window: str) -> DataFrame:
    """``hits`` with ``allowed``: at most ``limit`` in a window that opens with the first hit after the last one has ended.

    A window's start depends on the one before, so each key is walked in order; a task holds one
    window, however many hits a key has.
    """
    import pandas as pd

    span = pd.Timedelta(window).value // 1000
    ordered = walked(hits, key, at, tie)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in hits.schema)}, allowed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, ends, n = None, None, 0
        for batch in batches:
            allowed = []
            times = batch.column(at).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()
            for name, t in zip(batch.column(key).to_pylist(), times, strict=True):
                if name != who or ends is None or ends <= t:
                    who, ends, n = name, t + span, 0
                n += 1
                allowed.append(n <= limit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed)], names=[*batch.schema.names, "allowed"])

    return ordered.mapInArrow(run, schema)


def license_state(expires_at: Column, grace_days: Column, now: Column) -> Column:
    """open, valid, expiring (under 30 days left), grace or frozen."""
    left = F.unix_micros(expires_at) - F.unix_micros(now)
    day = F.lit(86_400_000_000)
    return (
        F.when(expires_at.isNull(), "open")
        .when((left >= 0) & (left < 30 * day), "expiring")
        .when(left >= 0, "valid")
        .when(-left <= grace_days * day, "grace")
        .otherwise("frozen")
    )
