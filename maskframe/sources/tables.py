"""Stored tables that change: keyed rows in hash buckets under a log of versions, and the vault, audit log and checkpoint heads in them.

A commit writes its rows as one more file set for each bucket they fall into, then claims the next
version by creating its manifest, which fails where another writer was first; the loser looks at the
new version and makes its rows anew. Manifests say which batch each writer wrote last, so a batch that
comes again changes nothing. A read takes the latest row of each key, bucket by bucket; a bucket with
more than ``deltas`` file sets is rewritten as one by the commit that passes the number. Lookups read
the buckets of the keys that are asked for, and no others.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.operators import audit
from maskframe.operators import vault as V

VERSION, DELETED, BUCKET = "__version", "__deleted", "__bucket"


class Conflict(Exception):
    """Another writer was first."""


class Files:
    """The few file operations a log needs, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(path)).toString()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Makes a file with its whole content, or raises Conflict where there is one of that name."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self.path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.root.startswith("file:"):
                here = self.root.removeprefix("file:").replace("///", "/", 1)
                os.link(f"{here}/{part}", f"{here}/{name}")  # a rename would put the other's file away
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.conf)
                none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(self.path(part), self.path(name), none)
        except FileExistsError:
            raise Conflict(name) from None
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(name) from None
            raise
        finally:
            self.fs.delete(self.path(part), False)


class Snapshot:
    """A table at a version."""

    def __init__(self, table: KeyedTable, manifest: dict):
        self.table, self.manifest, self.version = table, manifest, manifest["version"]

    def _rows(self, buckets: list[int] | None) -> DataFrame:
        t = self.table
        wanted = [int(b) for b in self.manifest["buckets"]] if buckets is None else buckets
        folders = [f"{t.files.root}/data/{d}/{BUCKET}={b}" for b in wanted for d in self.manifest["buckets"].get(str(b), [])]
        stored = T.StructType([*t.schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(DELETED, T.BooleanType())])
        if not folders:
            return t.spark.createDataFrame([], stored)
        return t.spark.read.schema(stored).parquet(*folders)

    def rows(self, buckets: list[int] | None = None, where: Column | None = None) -> DataFrame:
        """The latest row of each key (of some buckets); ``where`` is on key columns, so it reaches the scan."""
        found = self._rows(buckets)
        found = found if where is None else found.filter(where)
        last = found.groupBy(*self.table.keys).agg(F.max_by(F.struct(*found.columns), VERSION).alias("__last"))
        return last.filter(~F.col(f"__last.{DELETED}")).select("__last.*").select(*self.table.schema.names)

    def lookup(self, wanted: DataFrame, where: Column | None = None) -> DataFrame:
        """Rows whose bucket columns (all of ``bucket_by``) occur in ``wanted``; other buckets are not read."""
        by = self.table.bucket_by
        asked = wanted.select(*by).distinct()
        buckets = sorted(r[0] for r in asked.select(self.table.bucket()).distinct().collect())  # as many as buckets at most
        return self.rows(buckets, where).join(asked, by, "left_semi")


class KeyedTable:
    """Rows with a key, in buckets by the hash of ``bucket_by`` (part of the key; all of it by default)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], bucket_by: list[str] | None = None, buckets: int = 64, deltas: int = 8):
        self.spark, self.files = spark, Files(spark, path)
        self.schema, self.keys, self.bucket_by = T.StructType.fromDDL(schema), keys, bucket_by or keys
        self.buckets, self.deltas = buckets, deltas
        if not self.files.names("log"):
            try:
                self._claim({"version": 0, "buckets": {}, "batches": {}, "n_buckets": buckets, "bucket_by": self.bucket_by})
            except Conflict:
                pass
        first = json.loads(self.files.read(f"log/{0:012d}.json"))
        if (first["n_buckets"], first["bucket_by"]) != (buckets, self.bucket_by):
            raise ValueError(f"the table has {first['n_buckets']} buckets by {first['bucket_by']}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def snapshot(self) -> Snapshot:
        last = max(n for n in self.files.names("log") if n.endswith(".json"))
        return Snapshot(self, json.loads(self.files.read(f"log/{last}")))

    def _claim(self, manifest: dict) -> None:
        self.files.create(f"log/{manifest['version']:012d}.json", json.dumps(manifest, sort_keys=True))

    def commit(self, make: Callable[[Snapshot], DataFrame | None], writer: str, batch: int, tries: int = 20) -> bool:
        """Writes the rows that ``make`` draws from the latest version (key, columns, and __deleted where rows go); False where the batch is known.

        Where another writer commits in between, ``make`` is asked again, with what is there then.
        """
        for _ in range(tries):
            now = self.snapshot()
            if now.manifest["batches"].get(writer, -1) >= batch:
                return False
            manifest = {**now.manifest, "version": now.version + 1, "batches": {**now.manifest["batches"], writer: batch}}
            rows = make(now)
            if rows is not None:
                manifest["buckets"] = self._write(rows, now)
            try:
                self._claim(manifest)
                return True
            except Conflict:
                continue  # the rows written lie in a folder that no manifest names
        raise Conflict(f"{tries} tries")

    def _write(self, rows: DataFrame, now: Snapshot) -> dict:
        gone = F.col(DELETED) if DELETED in rows.columns else F.lit(False)
        stored = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(now.version + 1).cast("long").alias(VERSION), gone.alias(DELETED), self.bucket())
        folder = uuid.uuid4().hex
        self._store(stored, folder)
        held = {b: list(d) for b, d in now.manifest["buckets"].items()}
        for name in self.files.names(f"data/{folder}"):
            if name.startswith(BUCKET):
                held.setdefault(name.split("=")[1], []).append(folder)
        full = [b for b, d in held.items() if len(d) > self.deltas and d[-1] == folder]
        if full:
            # Deleted keys are dropped with the file sets that held them.
            again = uuid.uuid4().hex
            merged = Snapshot(self, {**now.manifest, "buckets": held}).rows([int(b) for b in full])
            self._store(merged.select("*", F.lit(now.version + 1).cast("long").alias(VERSION), F.lit(False).alias(DELETED), self.bucket()), again)
            made = {n.split("=")[1] for n in self.files.names(f"data/{again}") if n.startswith(BUCKET)}
            held |= {b: [again] if b in made else [] for b in full}
        return {b: d for b, d in held.items() if d}

    def _store(self, rows: DataFrame, folder: str) -> None:
        at = f"{self.files.root}/data/{folder}"
        rows.repartition(self.buckets, BUCKET).sortWithinPartitions(BUCKET, *self.keys).write.partitionBy(BUCKET).option("compression", "zstd").parquet(at)

    def sink(self, writer: str, make: Callable[[DataFrame, Snapshot], DataFrame | None]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each micro-batch is committed once, however often it comes."""

        def run(batch: DataFrame, number: int) -> None:
            held = batch.persist()  # a commit that loses reads it again
            try:
                self.commit(lambda now: make(held, now), writer, number)
            finally:
                held.unpersist()

        return run


class StoredVault:
    """The vault on disk: values under AES-GCM, found again by keyed digest, bucketed by scope."""

    SCHEMA = "tenant_id string, session_id string, placeholder string, entity_type string, value_hmac string, sealed binary, expires_at timestamp"

    def __init__(self, spark: SparkSession, path: str, data_key: bytes, secret: str, buckets: int = 64):
        self.table = KeyedTable(spark, path, self.SCHEMA, [*V.SCOPE, "placeholder"], V.SCOPE, buckets)
        self.key, self.secret = F.lit(data_key), secret

    def _open(self, rows: DataFrame) -> DataFrame:
        return V.unseal(rows, self.key).withColumnRenamed("entity_type", "type")

    def intern(self, values: DataFrame, expires_at: Column, now: Column, writer: str, batch: int) -> bool:
        """Gives the scopes' new values (scope, type, label, value, first_seen) their rows; a batch that comes again changes nothing."""

        def make(at: Snapshot) -> DataFrame:
            held = self._open(at.lookup(values)).select(*V.SCOPE, "type", "value", "placeholder", "expires_at")
            fresh = V.intern(held, values, expires_at, now)
            # A nonce is used once: no other row has this scope, placeholder and version.
            nonce = F.substring(F.unhex(F.sha2(F.concat_ws("\0", F.lit(self.secret), F.lit(at.version), *V.SCOPE, "placeholder"), 256)), 1, 12)
            return V.seal(fresh, self.key, nonce, self.secret)[0]

        return self.table.commit(make, writer, batch)

    def resolve(self, wanted: DataFrame, now: Column) -> DataFrame:
        """Values of placeholders (scope, placeholder) that have not expired; reads the scopes' buckets alone."""
        return V.resolve(self._open(self.table.snapshot().lookup(wanted)), wanted, now)

    def by_digest(self, wanted: DataFrame) -> DataFrame:
        """Placeholders of values known by their stored digest (scope, type, value_hmac); nothing is opened or hashed."""
        rows = self.table.snapshot().lookup(wanted).select(*V.SCOPE, F.col("entity_type").alias("type"), "value_hmac", "placeholder")
        return wanted.join(rows, [*V.SCOPE, "type", "value_hmac"])

    def sweep(self, now: Column, writer: str, batch: int) -> bool:
        """Drops what has expired."""
        return self.table.commit(lambda at: at.rows().filter(F.col("expires_at") <= now).withColumn(DELETED, F.lit(True)), writer, batch)


class StoredLog:
    """Audit logs on disk: serialised appends, each record linked to the one before, heads in the same commit."""

    SCHEMA = "log string, seq bigint, payload string, prev_hash string, hash string, last_seq bigint"

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.table, self.key = KeyedTable(spark, path, self.SCHEMA, ["log", "seq"], ["log"], buckets), key

    def append(self, records: DataFrame, order: str, writer: str, batch: int) -> bool:
        """Appends records (log, payload) in the order of a column; each log goes on after its last record."""

        def make(at: Snapshot) -> DataFrame:
            heads = at.lookup(records, F.col("seq") == 0).select("log", F.col("last_seq").alias("__at"), "hash")
            rows = records.select("log", "payload", F.col(order).alias("seq"))
            linked = audit.append(rows, self.key, "log", stored=heads.withColumnRenamed("__at", "seq")).withColumn("last_seq", F.lit(None).cast("long"))
            tops = linked.groupBy("log").agg(F.max_by("hash", "seq").alias("hash"), F.max("seq").alias("last_seq"))
            return linked.unionByName(tops.withColumn("seq", F.lit(0).cast("long")), allowMissingColumns=True)

        return self.table.commit(make, writer, batch)

    def records(self, logs: DataFrame | None = None, first: int = 1, last: int | None = None) -> DataFrame:
        """Records of a range of seq; the range reaches the scan, and only the buckets of ``logs`` are read."""
        span = F.col("seq").between(first, last) if last is not None else F.col("seq") >= first
        at = self.table.snapshot()
        return (at.rows(where=span) if logs is None else at.lookup(logs, span)).drop("last_seq")

    def heads(self) -> DataFrame:
        """(log, seq, hash) of each log's last record."""
        return self.table.snapshot().rows(where=F.col("seq") == 0).select("log", F.col("last_seq").alias("seq"), "hash")

    def verify(self, **how) -> DataFrame:
        """``audit.verify`` of all logs against their stored heads."""
        return audit.verify(self.records(), audit.record_hash(F.col("payload"), self.key), log="log", checkpoints=self.heads(), **how)


class StoredHeads:
    """Checkpoint heads on disk: they only go forward."""

    SCHEMA = "log string, seq bigint, hash string, mac string"

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.table, self.key = KeyedTable(spark, path, self.SCHEMA, ["log"], buckets=buckets), key

    def advance(self, wanted: DataFrame, writer: str, batch: int) -> bool:
        """Moves heads to (log, seq, hash); of several for a log the last counts. Another hash at a head's own seq is a ValueError and nothing is written."""

        def make(at: Snapshot) -> DataFrame:
            lines = audit.advance(at.lookup(wanted).select("log", "seq", "hash"), wanted, self.key, "log")
            if not lines.filter("error_code is not null").isEmpty():
                raise ValueError("a checkpoint conflicts with the one that is there")
            last = lines.groupBy("log").agg(F.max_by(F.struct("seq", "hash", "mac"), "seq").alias("l"))
            return last.select("log", "l.*")

        return self.table.commit(make, writer, batch)

    def heads(self) -> DataFrame:
        return self.table.snapshot().rows()

