"""Immutable shards with size-tiered compaction and an atomically committed manifest.

An arrival is written as one run: a folder of Parquet shards that never changes again. The
manifest lists the runs that make up the table. Every commit writes a whole new version beside
the others and renames it into place without overwriting, so readers see the old version or the
new one, and of two writers that start from one version the second fails and starts again.

Runs of like size (within a factor of ``LIKE`` of the smallest) form a tier; a tier with
``fan_in`` runs is merged into one run of files of about ``target_bytes``. Since the shards of a
tier are alike, merging reads whole shards into each new file and shuffles nothing, and a row
is rewritten once a tier, so about log(size) times.

Rows are kept whatever they hold, nulls, empty and repeated ones too. The manifest knows each
run's columns: an arrival may bring new ones, which are null in older rows, or lack some; a column
whose type differs from the table's is refused. A table without arrivals cannot be read; an empty
arrival adds an empty run. Runs of writers that died are never listed; ``vacuum`` removes them.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 64 << 20
FAN_IN = 4
LIKE = 2.0
MANIFEST = "run string, bytes long, n_rows long, tier int, columns string"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def merged(schemas: list[str]) -> T.StructType:
    """The columns of all of some schemas (JSON), in order of first appearance, all nullable."""
    fields: dict[str, T.StructField] = {}
    for text in dict.fromkeys(schemas):
        for f in T.StructType.fromJson(json.loads(text)).fields:
            known = fields.setdefault(f.name, T.StructField(f.name, f.dataType))
            if known.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {known.dataType.simpleString()} in the table, not {f.dataType.simpleString()}")
    return T.StructType(list(fields.values()))


class ShardTable:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.fs.Path("/".join([self.path, *names]))

    def version(self) -> int:
        """The last committed version; 0 if there is none."""
        folder = self._at("manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([int(n[1:]) for n in names if n.startswith("v")], default=0)

    def runs(self, version: int | None = None) -> list:
        """The runs of a version: some rows for each tier."""
        version = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{version:08d}").orderBy("run").collect() if version else []

    def _commit(self, version: int, runs: list) -> int:
        """Makes ``runs`` the version after ``version``."""
        draft = f"draft-{uuid.uuid4().hex}"
        self.spark.createDataFrame([tuple(r) for r in runs], MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{draft}")
        context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._at("manifest", draft), self._at("manifest", f"v{version + 1:08d}"), none)
        except Exception as e:
            self._fs.delete(self._at("manifest", draft), True)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version + 1} of {self.path} exists") from e
            raise
        return version + 1

    def _write(self, rows: DataFrame, tier: int, per_file: int = 0) -> tuple:
        run, seen = f"run-{uuid.uuid4().hex}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(f"{self.path}/data/{run}")
        return run, int(self._fs.getContentSummary(self._at("data", run)).getLength()), int(seen.get.get("n") or 0), tier, rows.schema.json()

    def _read(self, runs: list) -> DataFrame:
        return self.spark.read.schema(merged([r.columns for r in sorted(runs, key=lambda r: (-r.tier, r.run))])).parquet(*[f"{self.path}/data/{r.run}" for r in runs])

    def append(self, rows: DataFrame, compact: bool = True) -> int:
        """Adds an arrival and merges what has become due; returns the version."""
        merged([*[r.columns for r in self.runs()], rows.schema.json()])
        made = self._write(rows, 0)
        while True:
            at = self.version()
            runs = self.runs(at)
            merged([*[r.columns for r in runs], made[-1]])
            try:
                self._commit(at, [*runs, made])
                break
            except Conflict:
                continue
        return self.compact() if compact else at + 1

    def _due(self, runs: list) -> list:
        """The smallest tier that is full, or nothing."""
        runs = sorted(runs, key=lambda r: (r.bytes, r.run))
        while runs:
            tier = [r for r in runs if r.bytes <= LIKE * runs[0].bytes]
            if len(tier) >= self.fan_in:
                return tier
            runs = runs[len(tier) :]
        return []

    def compact(self) -> int:
        """Merges full tiers until none is left."""
        while tier := self._due(runs := self.runs(at := self.version())):
            files = max(1, math.ceil(sum(r.bytes for r in tier) / self.target))
            # Coalescing joins shards that are too small; a limit on rows parts those that would be too large.
            per_file = math.ceil(sum(r.n_rows for r in tier) / files)
            made = self._write(self._read(tier).coalesce(files), 1 + max(r.tier for r in tier), per_file)
            gone = {r.run for r in tier}
            try:
                self._commit(at, [*[r for r in runs if r.run not in gone], made])
            except Conflict:
                self._fs.delete(self._at("data", made[0]), True)
        return self.version()

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.runs(version))

    def vacuum(self, keep: int = 1, orphan_seconds: float = 86_400) -> None:
        """Deletes versions before the last ``keep``, runs that no later one lists, and what dead writers left.

        Readers of old versions must have ended. Unlisted runs and drafts are deleted once they
        are older than ``orphan_seconds``, the longest that a writer may take.
        """
        last = self.version()
        kept = {r.run for v in range(max(1, last - keep + 1), last + 1) for r in self.runs(v)}
        old = {r.run for v in range(1, last - keep + 1) if self._fs.exists(self._at("manifest", f"v{v:08d}")) for r in self.runs(v)}
        before = time.time() * 1000 - orphan_seconds * 1000
        for folder in ("data", "manifest"):
            for status in self._fs.listStatus(self._at(folder)) if self._fs.exists(self._at(folder)) else []:
                name = status.getPath().getName()
                if name.startswith(("run-", "draft-")) and name not in kept and (name in old or status.getModificationTime() <= before):
                    self._fs.delete(status.getPath(), True)
        for v in range(1, last - keep + 1):
            self._fs.delete(self._at("manifest", f"v{v:08d}"), True)
