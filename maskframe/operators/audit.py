"""The audit log: linked records, verification, paging, metrics and period reports."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions.arrow import walked
from maskframe.functions.canonical import canonical_json

ENTITY = "struct<type:string,action:string,count:int>"
RECORD = f"seq bigint, ts timestamp, kind string, actor string, session_id string, request_sha256 string, entities array<{ENTITY}>, prev_hash string, hash string"
KINDS = ("MASK_APPLIED", "REQUEST_BLOCKED", "VAULT_RESOLVE", "POLICY_CHANGED")
GENESIS = hashlib.sha256(b"maskframe-genesis-v1").hexdigest()


def _sorted(value: Column, kind: T.DataType) -> Column:
    """``value`` with the keys of all its structs in order, and its numbers as doubles where they have a fraction."""
    if isinstance(kind, T.StructType):
        made = F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _sorted(x, kind.valueType))  # keys are put in order afterwards
    if isinstance(kind, T.DecimalType):
        return value.cast("double")
    if isinstance(kind, T.FractionalType):
        # The JVM would write these as text.
        none = F.raise_error(F.lit("JSON has no such number")).cast("double")
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), none).otherwise(value.cast("double"))
    return value


def _plain(kind: T.DataType) -> bool:
    """Whether the JVM's JSON of such values is canonical but for escapes: whole numbers of 32 bits, text, and known ASCII keys."""
    if isinstance(kind, T.StructType):
        return all(f.name.isascii() and _plain(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    return isinstance(kind, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.DateType, T.TimestampType, T.TimestampNTZType))


def canonical(df: DataFrame, *columns: str) -> Column:
    """One line of canonical JSON (RFC 8785); nulls are kept.

    Keys are in order at every depth and numbers as ECMAScript writes doubles, so long ones beyond
    2^53 are rounded, as there. NaN, infinities and halves of surrogate pairs are errors. Records of
    text, truth values and 32-bit numbers stay in the JVM but for control characters.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    line = F.to_json(F.struct(*[_sorted(F.col(f"`{c}`"), kinds[c]).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    if all(c.isascii() and _plain(kinds[c]) for c in columns):
        odd = line.rlike(r"\\u00")
    elif all(c.isascii() and (_plain(kinds[c]) or isinstance(kinds[c], T.LongType)) for c in columns):
        odd = line.rlike(r"\\u00|[0-9]{16}")
    else:
        return canonical_json(line).alias("canonical")
    return F.when(odd, canonical_json(F.when(odd, line))).otherwise(line).alias("canonical")


def keyed_hash(key: str, domain: str = ""):
    """HMAC-SHA256 of strings, in hexadecimal; a ``domain`` keeps the uses of one key apart."""
    secret, prefix = key.encode(), f"{domain}\0".encode() if domain else b""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hmac.new(secret, prefix + t.encode(), hashlib.sha256).hexdigest() for t in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


#: What the keyed hashes of values and of checkpoints start with.
FINGERPRINT, CHECKPOINT = "maskframe-audit-fingerprint-v1", "maskframe-audit-checkpoint-v1"


def fingerprint(value: Column, key: str) -> Column:
    """A keyed digest of a value, of no use for any other purpose of the key."""
    return keyed_hash(key, FINGERPRINT)(value)


#: What a record without a payload is hashed as: JSON's null, which no text of JSON's strings or objects is.
NULL_PAYLOAD = "null"


def record_hash(payload: Column, key: str) -> Column:
    """What the hash of a record with this payload must be, from its prev_hash."""
    return keyed_hash(key)(F.concat(F.coalesce(payload, F.lit(NULL_PAYLOAD)), "prev_hash"))


def append(records: DataFrame, key: str, log: str, seq: str = "seq", payload: str = "payload", stored: DataFrame | None = None) -> DataFrame:
    """Links the records of each log in the order of ``seq``: prev_hash and hash are added.

    Without ``stored``, a log begins at the genesis and ``seq`` stands as given. With it (log, seq
    and hash of what is there), each log goes on after its last record and ``seq`` is made anew. A
    chain is serial by nature: a task walks its logs record by record and holds one hash each. A null
    payload is hashed as ``NULL_PAYLOAD`` (``record_hash`` does likewise).
    """
    secret, order, more = key.encode(), seq, stored is not None
    columns = records.columns
    if stored is not None:
        last = stored.groupBy(log).agg(F.max(seq).alias("__seq"), F.max_by("hash", seq).alias("__hash"))
        records, columns, order = records.withColumnRenamed(seq, "__order").join(last, log, "left"), [c for c in columns if c != seq], "__order"
    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    ordered = walked(records, log, order)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], *([f"`{seq}` bigint"] if more else []), "prev_hash string, hash string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, number = (), GENESIS, 0  # no name equals the first ``at``
        for batch in batches:
            before, after, numbers = [], [], []
            base, head = (batch.column(c).to_pylist() if more else [None] * batch.num_rows for c in ("__seq", "__hash"))
            for name, text, b, h in zip(batch.column(log).to_pylist(), batch.column(payload).to_pylist(), base, head, strict=True):
                if name != at:
                    at, last, number = name, h or GENESIS, b or 0
                number += 1
                numbers.append(number)
                before.append(last)
                last = hmac.new(secret, ((NULL_PAYLOAD if text is None else text) + last).encode(), hashlib.sha256).hexdigest()
                after.append(last)
            own = [batch.column(c) for c in columns] + ([pa.array(numbers, pa.int64())] if more else [])
            names = [*columns, *([seq] if more else []), "prev_hash", "hash"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(before, pa.string()), pa.array(after, pa.string())], names=names)

    return ordered.mapInArrow(run, schema)


def verify(records: DataFrame, expected: Column, seq: str = "seq", first: int = 1, last: int | None = None, log: str | None = None, checkpoints: DataFrame | None = None, genesis: str = GENESIS) -> DataFrame:
    """Checks a whole log at once: a row with ok, verified, first_broken_seq and out_of_range (a row a log, with ``log``).

    A log is whole if its records are numbered from 1 without gaps or repeats, the first one
    links to the genesis, every other to the hash of the one before, and each hash is what
    ``expected`` makes of the stored columns. ``checkpoints`` (seq and hash, and the log's name)
    must be the last record of its log: a shorter log is broken after its end, a longer one after
    the checkpoint, another hash after the checkpoint too. Of several checkpoints the one with the
    largest seq counts; two hashes at that seq fit no record. ``verified`` counts records from
    ``first`` to ``last`` before the first break, and ``out_of_range`` says that it lies outside.

    A record and, at the place after them, its predecessor's hash and a checkpoint meet in one grouping by seq, so no
    window spans a log and nothing is joined.
    """
    keys = [log or "__log"]
    rows = records if log else records.withColumn("__log", F.lit(1))
    # A record is sent to its own place with what it links to, and to the next with its hash; whether it is what is expected is judged where it lies.
    own = rows.select(*keys, seq, "prev_hash", F.coalesce(F.col("hash") == expected, F.lit(False)).alias("__sound"), F.lit(1).alias("__own"))
    before = rows.select(*keys, (F.col(seq) + 1).alias(seq), F.col("hash").alias("__before"))
    both = own.unionByName(before, allowMissingColumns=True)
    columns = ["prev_hash", "__before", "__sound"]
    if checkpoints is not None:
        points = checkpoints if log else checkpoints.withColumn("__log", F.lit(1))
        both = both.unionByName(points.select(*keys, (F.col("seq") + 1).alias(seq), F.col("hash").alias("__point"), F.col("hash").alias("__other")), allowMissingColumns=True)
        columns.append("__point")
    folds = [F.count("__own").alias("n"), *[F.max(c).alias(c) for c in columns]]
    met = both.groupBy(*keys, seq).agg(*folds, *([F.min("__other").alias("__other")] if checkpoints is not None else []))
    link = F.when(F.col(seq) == 1, F.lit(genesis)).otherwise(F.col("__before"))
    sound = (F.col("n") == 1) & (F.col("prev_hash") == link) & F.col("__sound") & (F.col(seq) >= 1)
    record = F.col("n") > 0
    met = met.withColumn("__broken", F.when(record & ~F.coalesce(sound, F.lit(False)), F.col(seq)))
    # A place without a record, but with one before it, ends a run of records.
    run = F.when(F.max(F.when(record & (F.col(seq) == 1), True)), F.min(F.when(~record, F.col(seq) - 1))).otherwise(0)
    sums = [F.min("__broken").alias("broken"), F.max(F.when(record, F.col(seq))).alias("latest"), run.alias("run")]
    if checkpoints is not None:
        fits = (F.col("__before") == F.col("__point")) & (F.col("__before") == F.col("__other"))
        sums.append(F.max(F.when(F.col("__point").isNotNull(), F.struct((F.col(seq) - 1).alias("at"), F.coalesce(fits, F.lit(False)).alias("anchored")))).alias("__last_point"))
    total = met.groupBy(*(keys if log else [])).agg(*sums)
    broken = F.col("broken")
    if checkpoints is not None:
        total = total.withColumns({"at": F.col("__last_point.at"), "anchored": F.col("__last_point.anchored")})
        latest = F.coalesce("latest", F.lit(0))
        held = F.col("at").isNull() | (F.coalesce("anchored", F.lit(False)) & (latest == F.col("at")))
        broken = F.coalesce("broken", F.when(~held, F.when(latest < F.col("at"), latest + 1).otherwise(F.col("at") + 1)))
    total = total.withColumns({"first_broken_seq": broken.cast("long"), "__end": F.least(F.coalesce(F.col("broken") - 1, "run"), "run")})
    upper = F.col("__end") if last is None else F.least("__end", F.lit(last))
    outside = F.col("first_broken_seq") < first
    if last is not None:
        outside = outside | (F.col("first_broken_seq") > last)
    return total.select(*([log] if log else []), F.col("first_broken_seq").isNull().alias("ok"), F.greatest(F.lit(0), upper - first + 1).cast("long").alias("verified"), "first_broken_seq", F.coalesce(outside, F.lit(False)).alias("out_of_range"))


def against_checkpoints(records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints (seq, hash) whose record is missing or has another hash."""
    stored = records.select("seq", F.col("hash").alias("stored_hash"))
    return checkpoints.join(stored, "seq", "left").filter(F.col("stored_hash").isNull() | (F.col("stored_hash") != F.col("hash")))


def advance(heads: DataFrame, wanted: DataFrame, key: str, log: str) -> DataFrame:
    """Checkpoint lines to add (log, v, seq, hash, mac, error_code) so that heads (log, seq, hash) reach what is wanted.

    Heads only go forward: what lies at or before one adds nothing, and another hash at a head's own
    seq is a CONFLICT.
    """
    head = heads.select(log, F.col("seq").alias("__seq"), F.col("hash").alias("__hash"))
    rows = wanted.select(log, "seq", "hash").join(head, log, "left")
    conflict = (F.col("seq") == F.col("__seq")) & (F.col("hash") != F.col("__hash"))
    rows = rows.filter(F.col("__seq").isNull() | (F.col("seq") > F.col("__seq")) | conflict)
    mac = keyed_hash(key, CHECKPOINT)(F.concat_ws("\0", F.col("seq").cast("string"), "hash"))
    return rows.select(log, F.lit(1).alias("v"), "seq", "hash", mac.alias("mac"), F.when(conflict, F.lit("CONFLICT")).alias("error_code"))


def reconcile(records: DataFrame, expected: Column, heads: DataFrame, log: str, bootstrap: bool = False) -> DataFrame:
    """What is to be done about each log before it may go on: (log, state, seq, hash of its last record).

    CURRENT: its head is its last record. ADVANCE: it has records past its head. BROKEN: the chain
    fails. LOST_HEAD: its head is not among its records. UNANCHORED: it has no head, and
    ``bootstrap`` doesn't allow to make one.
    """
    state = verify(records, expected, log=log).select(log, "ok")
    last = records.groupBy(log).agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
    head = heads.select(log, F.col("seq").alias("__at"), F.col("hash").alias("__point"))
    points = head.withColumnsRenamed({"__at": "seq", "__point": "hash"})
    held = records.select(log, "seq", "hash").join(points, [log, "seq", "hash"]).select(log, F.lit(True).alias("__held")).distinct()
    rows = state.join(last, log).join(head, log, "full").join(held, log, "left")
    what = (
        F.when(~F.col("ok"), "BROKEN")
        .when(F.col("__at").isNotNull() & F.col("__held").isNull(), "LOST_HEAD")
        .when(F.col("__at").isNull() & F.lit(not bootstrap), "UNANCHORED")
        .when(F.col("__at").isNull() | (F.col("seq") > F.col("__at")), "ADVANCE")
        .otherwise("CURRENT")
    )
    return rows.select(log, what.alias("state"), "seq", "hash")


def anchors(days: DataFrame, day: str = "day") -> DataFrame:
    """The anchor event of each day, to be appended like any other."""
    text = F.date_format(day, "yyyy-MM-dd")
    return days.select(F.lit("ANCHOR").alias("kind"), F.lit("system:audit").alias("actor"), F.lit(None).cast("string").alias("session_id"), F.sha2(text, 256).alias("request_sha256"), F.array().cast(f"array<{ENTITY}>").alias("entities"))


def scan(records: DataFrame) -> DataFrame:
    """The whole log in the order of seq."""
    return records.orderBy("seq")


def page(records: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    """A page of the log, latest first."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages start at 1 and hold 1 to 100 rows")
    return records.orderBy(F.desc("seq")).offset((number - 1) * size).limit(size)


def page_count(total: Column, size: int = 20) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size))


def latest(records: DataFrame) -> DataFrame:
    return records.orderBy(F.desc("seq")).limit(1)


def in_range(records: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Records of a seq range; the bounds reach the scan."""
    rows = records.filter(F.col("seq") >= first)
    return rows if last is None else rows.filter(F.col("seq") <= last)


def export(records: DataFrame, path: str, first: int, last: int | None = None) -> None:
    """Writes a range as newline-delimited JSON."""
    in_range(records, first, last).select(canonical(records, *records.columns).alias("value")).write.text(path)


def kind_counts(records: DataFrame) -> DataFrame:
    """Masked and blocked events, and all."""
    return records.agg(F.count_if(F.col("kind") == "MASK_APPLIED").alias("masked"), F.count_if(F.col("kind") == "REQUEST_BLOCKED").alias("blocked"), F.count("*").alias("events"))


def entity_totals(records: DataFrame) -> DataFrame:
    """Sum of counts of each entity type."""
    return records.select(F.inline("entities")).groupBy("type").agg(F.sum("count").alias("total"))


def ranked_entities(records: DataFrame) -> DataFrame:
    return entity_totals(records).orderBy(F.desc("total"), "type")


def bars(records: DataFrame, most: int = 8) -> DataFrame:
    """The entities that occur most, each with its share of the largest total."""
    top = entity_totals(records).orderBy(F.desc("total"), "type").limit(most)
    largest = top.agg(F.max("total").alias("largest"))
    return top.join(F.broadcast(largest)).select("type", "total", (F.col("total") / F.col("largest")).alias("share"))  # one row against ``most``


def in_period(records: DataFrame, start: str, end: str) -> DataFrame:
    """Records from the start of one UTC day to the last millisecond of another."""
    return records.filter((F.col("ts") >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz")) & (F.col("ts") <= F.lit(f"{end} 23:59:59.999").cast("timestamp_ntz")))


def period_report(records: DataFrame, start: str, end: str) -> DataFrame:
    """The totals of a period. ``masked`` sums masked entities of every kind of event, ``masked_strict`` those of masking alone."""
    masked = F.aggregate(F.filter("entities", lambda e: e["action"] == "mask"), F.lit(0).cast("long"), lambda n, e: n + e["count"])
    return in_period(records, start, end).withColumn("__masked", masked).agg(
        F.count("*").alias("events"),
        F.coalesce(F.sum("__masked"), F.lit(0)).alias("masked"),
        F.coalesce(F.sum(F.when(F.col("kind") == "MASK_APPLIED", F.col("__masked"))), F.lit(0)).alias("masked_strict"),
        F.count_if(F.col("kind") == "REQUEST_BLOCKED").alias("blocked"),
        F.count_if(F.col("kind") == "VAULT_RESOLVE").alias("vault_resolves"),
        F.count_if(F.col("kind") == "POLICY_CHANGED").alias("policy_changes"),
    )


def audited_report(records: DataFrame, expected: Column, start: str, end: str, checkpoints: DataFrame | None = None) -> DataFrame:
    """The totals of a period with the state of the whole log: chain_ok and first_broken_seq (one row)."""
    chain = verify(records, expected, checkpoints=checkpoints).select(F.col("ok").alias("chain_ok"), "first_broken_seq")
    return period_report(records, start, end).join(F.broadcast(chain))  # one row each


def from_events(spans: DataFrame, request: str, acted: DataFrame) -> DataFrame:
    """One MASK_APPLIED row a request: entity counts and the digest of their JSON."""
    counts = spans.join(F.broadcast(acted.select("type", "action")), "type").groupBy(request, "type", "action").agg(F.count("*").cast("int").alias("count"))
    rows = counts.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("type", "action", "count"))).alias("entities"))
    return rows.select(F.col(request), F.lit("MASK_APPLIED").alias("kind"), "entities", F.sha2(F.to_json("entities"), 256).alias("request_sha256"))
