"""Readers and writers of the file formats around the engine."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators.audit import RECORD
from maskframe.operators.corpus import rebuild_text, token_offsets
from maskframe.taxonomy import EXTERNAL_LABELS, LABELS, POLICY_DEFAULTS

GOLD = "id string, domain string, template_id string, morphology array<string>, text string, entities array<struct<type:string,start:int,end:int,text:string>>"
#: Items of ``ner`` are mixed JSON arrays, read as text and parsed.
PREPARED = "id string, source string, tokenized_text array<string>, ner array<array<string>>, ner_labels array<string>"
EXTERNAL = "id string, source_text string, text string, language string, locale string, privacy_mask array<struct<value:string,start:int,end:int,label:string>>"


def _checked(rows: DataFrame, good, what: str, strict: bool) -> DataFrame:
    if strict:
        return rows.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean")))
    return rows.withColumn("error_code", F.when(~F.coalesce(good, F.lit(False)), F.lit(what)))


def read_gold(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Gold examples; every entity must be what its offsets cut out of the text."""
    return _gold_checked(spark.read.schema(GOLD).json(path), strict)


def _gold_checked(rows: DataFrame, strict: bool) -> DataFrame:
    good = F.forall("entities", lambda e: (e["end"] > e["start"]) & (F.substring("text", e["start"] + 1, e["end"] - e["start"]) == e["text"]))
    return _checked(rows, good, "BAD_ENTITY", strict)


def read_prepared(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Token rows; every span must lie within the tokens and have a declared label."""
    return _prepared_checked(spark.read.schema(PREPARED).json(path), strict)


def _prepared_checked(rows: DataFrame, strict: bool) -> DataFrame:
    rows = rows.withColumn("ner", F.transform("ner", lambda x: F.struct(x[0].cast("int").alias("first"), x[1].cast("int").alias("last"), x[2].alias("label"))))
    good = F.forall("ner", lambda s: (s["first"] >= 0) & (s["last"] >= s["first"]) & (s["last"] < F.size("tokenized_text")) & F.array_contains("ner_labels", s["label"]))
    return _checked(rows, good, "BAD_SPAN", strict)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Gold and token rows, each line by its own shape, as (id, text, entities); text of token rows is put together anew."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    token_row = F.get_json_object("value", "$.tokenized_text").isNotNull()
    gold = _gold_checked(lines.filter(~token_row).select(F.from_json("value", GOLD).alias("r")).select("r.*"), True).select("id", "text", "entities")
    rows = _prepared_checked(lines.filter(token_row).select(F.from_json("value", PREPARED).alias("r")).select("r.*"), True)
    rows = rows.withColumns({"text": rebuild_text(F.col("tokenized_text")), "__at": token_offsets(F.col("tokenized_text"))})
    start = lambda s: F.get("__at", s["first"])
    end = lambda s: F.get("__at", s["last"]) + F.length(F.get("tokenized_text", s["last"]))
    entity = lambda s: F.struct(s["label"].alias("type"), start(s).alias("start"), end(s).alias("end"), F.substring("text", start(s) + 1, end(s) - start(s)).alias("text"))
    return gold.unionByName(rows.select("id", "text", F.transform("ner", entity).alias("entities")))


def read_external(spark: SparkSession, path: str, language: str = "tr") -> DataFrame:
    """An external privacy corpus: rows of one language, labels mapped to types, entities off their text dropped."""
    rows = spark.read.schema(EXTERNAL).json(path).withColumns({"text": F.coalesce("source_text", "text"), "language": F.lower(F.coalesce("language", "locale"))})
    known = F.create_map(*[F.lit(x) for kv in EXTERNAL_LABELS.items() for x in kv])
    mapped = F.transform("privacy_mask", lambda m: F.struct(F.element_at(known, F.upper(m["label"])).alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("text")))
    good = F.filter(mapped, lambda e: e["type"].isNotNull() & (F.substring("text", e["start"] + 1, e["end"] - e["start"]) == e["text"]))
    return rows.filter(F.col("language").startswith(language)).select("id", "text", good.alias("entities"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def read_checkpoints(spark: SparkSession, path: str, mac: str) -> DataFrame:
    """Checkpoint lines (v, seq, hash, mac) whose code fits, and the head among them."""
    from maskframe.operators.audit import CHECKPOINT, keyed_hash

    rows = spark.read.schema("v int, seq bigint, hash string, mac string").json(path)
    return rows.filter((F.col("v") == 1) & (keyed_hash(mac, CHECKPOINT)(F.concat_ws("\0", F.col("seq").cast("string"), "hash")) == F.col("mac")))


def head(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Event-stream files: a row for each frame (blank lines part frames, CRLF too), with its event name and data."""
    text = F.regexp_replace("value", "\r\n?", "\n")
    frames = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(text, "\n\n+")).alias("seq", "frame")).filter("trim(frame) <> ''")
    lines = F.split("frame", "\n")
    field = lambda name: F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", "")), "\n")
    return frames.select("file", "seq", field("event").alias("event"), field("data").alias("data"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Size and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest_digest(files: DataFrame) -> DataFrame:
    """One digest over the sorted digests of a model's files (a few rows)."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("  ", "sha256", "path"))), "\n"), 256).alias("sha256"))


def check_bundle(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Files (path, sha256) that are listed only, found only, or differ."""
    both = listed.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full")
    return both.withColumn("problem", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(F.col("a") != F.col("b"), "differs")).filter("problem is not null").select("path", "problem")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def load_policy(path: str) -> tuple[list[dict], dict]:
    """Rules and defaults of a policy file (YAML), checked."""
    import yaml

    from maskframe.operators.policy import check

    with open(path, encoding="utf-8") as f:
        spec = yaml.safe_load(f)
    if set(spec) - {"version", "defaults", "rules"}:
        raise ValueError("unknown keys in policy")
    rules = [{**r["match"], "action": r["action"]} for r in spec["rules"]]
    check(rules, {**POLICY_DEFAULTS, **spec.get("defaults", {})})
    return rules, {**POLICY_DEFAULTS, **spec.get("defaults", {})}


def load_taxonomy(path: str) -> list[tuple]:
    """Rows of a taxonomy file (YAML): types unique, labels 2 to 12 capitals, keys exact."""
    import re

    import yaml

    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f)["entities"]
    keys = ["type", "layer", "kvkk_class", "z_class", "default_action", "tr_label", "description"]
    if any(list(r) != keys and set(r) != set(keys) for r in rows) or len({r["type"] for r in rows}) != len(rows) or not all(re.fullmatch("[A-Z]{2,12}", r["tr_label"]) for r in rows):
        raise ValueError("not a taxonomy")
    return [tuple(r[k] for k in keys[:6]) for r in rows]


def label_of(type_: str) -> str:
    return LABELS[type_]


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """Per-type counts of many evaluation reports (JSON files): file, type, tp, fp, fn, support."""
    shape = "strict struct<per_type: map<string, struct<tp: bigint, fp: bigint, fn: bigint, support: bigint>>>"
    rows = spark.read.schema(shape).option("multiLine", "true").json(glob).select(F.input_file_name().alias("file"), F.explode("strict.per_type").alias("type", "x"))
    return rows.select("file", "type", "x.*")


def read_load_summary(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """The 95th percentile of a metric in load-test summaries (JSON): file, p95."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("file"), F.get_json_object("value", f"$.metrics['{metric}']['p(95)']").cast("double").alias("p95")).filter("p95 is not null")


def convert_examples(spark: SparkSession, source: str, target: str, limit: int | None = None) -> DataFrame:
    """Gold examples written as token rows (JSON lines), in the order of their ids; returns the number of rows and the digest of what was written."""
    from maskframe.operators.corpus import prepare

    rows = read_gold(spark, source).select("id", F.lit("gold").alias("source"), "text", "entities")
    if limit is not None:
        rows = rows.orderBy("id").limit(limit)
    made = prepare(rows)
    bad = made.filter("misaligned > 0").limit(1).count()
    if bad:
        raise ValueError("an entity does not begin and end with tokens")
    ner = F.transform("ner", lambda s: F.array(s["first"].cast("string"), s["last"].cast("string"), s["label"]))
    made.select("id", "source", "tokenized_text", ner.alias("ner"), "ner_labels").write.mode("errorifexists").json(target)
    # The digest does not depend on the order of lines: those of lines that begin alike first, then of all these.
    lines = spark.read.text(target).select(F.sha2("value", 256).alias("d"))
    joined = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d")
    return lines.groupBy(F.left("d", F.lit(4)).alias("p")).agg(F.count("*").alias("n"), joined()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined()).withColumnRenamed("d", "sha256")


def verify_lock(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a dataset lock (path, length, sha256) that are missing or not as locked."""
    both = listed.join(found.select("path", F.col("length").alias("__length"), F.col("sha256").alias("__sha256")), "path", "left")
    problem = F.when(F.col("__sha256").isNull(), "missing").when(F.col("__length") != F.col("length"), "length").when(F.col("__sha256") != F.col("sha256"), "digest")
    return both.select("path", problem.alias("problem")).filter("problem is not null")


def write_report(scores: DataFrame, path: str) -> None:
    """A result as JSON and as a Markdown table (some rows a type), both complete before either has its name."""
    import os
    import tempfile

    rows = [r.asDict() for r in scores.orderBy("recall", "type").collect()]
    columns = scores.columns
    table = "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows]])
    made = []
    for ending, text in ((".json", json.dumps(rows, ensure_ascii=False, sort_keys=True)), (".md", table)):
        with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(path) or ".", delete=False) as f:
            f.write(text + "\n")
            f.flush()
            os.fsync(f.fileno())
        made.append((f.name, path + ending))
    for name, final in made:
        os.replace(name, final)


def append_lines(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines without touching what is there."""
    rows.write.mode("append").json(path)


def config(environment: dict[str, str], schema: dict[str, tuple], prefix: str) -> dict:
    """Settings from an environment: name -> (type, default, least, most); a default of None makes one mandatory.

    A name with the prefix that the schema lacks is an error, and so is a value out of its bounds.
    """
    unknown = sorted(k for k in environment if k.startswith(prefix) and k.removeprefix(prefix) not in schema)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = {}
    for name, (kind, default, least, most) in schema.items():
        text = environment.get(prefix + name)
        if text is None and default is None:
            raise ValueError(f"{prefix}{name} is missing")
        out[name] = default if text is None else kind(text)
        if least is not None and out[name] < least or most is not None and out[name] > most:
            raise ValueError(f"{prefix}{name} is out of bounds")
    return out


def model_entry(path: str, model: str) -> dict:
    """A model's entry in a registry file (YAML): a pinned revision, and a size and SHA-256 for each file."""
    import re

    import yaml

    with open(path, encoding="utf-8") as f:
        entries = {m["id"]: m for m in yaml.safe_load(f)["models"]}
    if model not in entries:
        raise ValueError(f"no model {model}")
    entry = entries[model]
    if not re.fullmatch("[0-9a-f]{40}", str(entry.get("revision", ""))):
        raise ValueError(f"{model} is not pinned to a revision")
    if not entry.get("files") or any(not re.fullmatch("[0-9a-f]{64}", str(x.get("sha256", ""))) or not int(x.get("size", 0)) > 0 for x in entry["files"]):
        raise ValueError(f"{model} has files without size or digest")
    return entry
