"""Policy evaluation as joins: which action each type gets, and which policy a context gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskframe.functions import placeholders as P
from maskframe.operators.mask import nfc
from maskframe.taxonomy import LABELS, POLICY_DEFAULTS, POLICY_RULES

ACTIONS = ("allow", "mask", "block")


def check(rules: list[dict], defaults: dict[str, str]) -> None:
    """Rejects what is no policy: unknown keys, actions, or rules without one matcher."""
    for r in rules:
        if set(r) - {"types", "kvkk_class", "action"} or r.get("action") not in ACTIONS or len({"types", "kvkk_class"} & set(r)) != 1:
            raise ValueError(f"not a rule: {r}")
    if set(defaults) != set(POLICY_DEFAULTS) or defaults["unknown_entity"] not in ACTIONS:
        raise ValueError("policy defaults are incomplete")


def rules_table(spark: SparkSession, rules: list[dict] = POLICY_RULES) -> DataFrame:
    rows = [(i, r.get("types"), r.get("kvkk_class"), r["action"]) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_idx int, types array<string>, kvkk_class string, action string")


def actions(taxonomy: DataFrame, rules: DataFrame, default: str = POLICY_DEFAULTS["unknown_entity"]) -> DataFrame:
    """taxonomy with the action of each type: the first rule that names the type, else the first that names its class, else the default."""
    by_type = rules.select(F.explode("types").alias("type"), "rule_idx", "action").groupBy("type").agg(F.min_by("action", "rule_idx").alias("by_type"))
    by_class = rules.filter("kvkk_class is not null").groupBy("kvkk_class").agg(F.min_by("action", "rule_idx").alias("by_class"))
    found = taxonomy.join(F.broadcast(by_type), "type", "left").join(F.broadcast(by_class), "kvkk_class", "left")  # as many rows as a policy has
    return found.withColumn("action", F.coalesce("by_type", "by_class", F.lit(default))).drop("by_type", "by_class")


def select(policies: DataFrame, contexts: DataFrame, static: str | None = None) -> DataFrame:
    """The policy of each context (context_id, api_key_id, role): highest priority, then most specific, then least id.

    A null list does not constrain; an empty one matches nothing. Contexts without a match get the
    ``static`` policy (null if there is none).

    Any number of policies is joined by equality: a list is a row for each of its values, no list is
    one that any value meets, and of all policies for the same key and role only the best is left.
    A context meets at most four of those.
    """
    any_ = lambda ids: F.when(F.col(ids).isNull(), F.array(F.lit(None))).otherwise(F.filter(ids, lambda x: x.isNotNull()))
    specific = F.col("api_key_ids").isNotNull().cast("int") + F.col("roles").isNotNull().cast("int")
    flat = policies.withColumn("specificity", specific).select("policy_id", "priority", "specificity", F.explode(any_("api_key_ids")).alias("k"), "roles")
    flat = flat.select("policy_id", "priority", "specificity", "k", F.explode(any_("roles")).alias("r"))
    rank = F.struct(F.col("priority"), F.col("specificity"))
    best = flat.groupBy("k", "r").agg(F.max(rank).alias("rank"))
    best = flat.withColumn("rank", rank).join(best.withColumnsRenamed({"k": "__k", "r": "__r", "rank": "__rank"}), F.col("k").eqNullSafe(F.col("__k")) & F.col("r").eqNullSafe(F.col("__r")) & (F.col("rank") == F.col("__rank")))
    best = best.groupBy("k", "r", "rank").agg(F.min("policy_id").alias("policy_id")).select(F.col("k").alias("__k"), F.col("r").alias("__r"), "rank", "policy_id")
    own = F.struct(F.col("api_key_id").alias("k"), F.col("role").alias("r"))
    none_k, none_r = F.lit(None).cast(dict(contexts.dtypes)["api_key_id"]), F.lit(None).cast(dict(contexts.dtypes)["role"])
    tries = F.array_distinct(F.array(own, F.struct(F.col("api_key_id").alias("k"), none_r.alias("r")), F.struct(none_k.alias("k"), F.col("role").alias("r"))))
    # The one policy for all contexts is a single row: it comes in as a value and is no key of the join.
    wild = best.filter("__k is null and __r is null").agg(F.first(F.struct("rank", "policy_id")).alias("__wild"))
    asked = contexts.select("context_id", F.explode(tries).alias("t")).select("context_id", "t.k", "t.r").filter("k is not null or r is not null")
    met = asked.join(best.filter("__k is not null or __r is not null"), F.col("k").eqNullSafe(F.col("__k")) & F.col("r").eqNullSafe(F.col("__r"))).select("context_id", "rank", "policy_id")
    everyone = contexts.select("context_id").join(F.broadcast(wild)).select("context_id", "__wild.rank", "__wild.policy_id")
    found = met.unionByName(everyone).filter("policy_id is not null")
    # Among equals the least id wins: of at most four rows a context, so they are gathered.
    order = F.array_sort(F.collect_list(F.struct((-F.col("rank.priority")).alias("a"), (-F.col("rank.specificity")).alias("b"), "policy_id", "rank")))
    first = found.groupBy("context_id").agg(F.get(order, F.lit(0)).alias("x")).select("context_id", "x.policy_id", "x.rank")
    out = contexts.select("context_id").join(first, "context_id", "left")
    return out.select("context_id", F.coalesce("policy_id", F.lit(static)).alias("policy_id"), F.col("rank.priority").alias("priority"), F.col("rank.specificity").alias("specificity"))


def upsert(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """Policies after changes (with ``version``; ``deleted`` removes): the last version of each id."""
    rows = policies.withColumns({"version": F.lit(-1).cast("long"), "deleted": F.lit(False)}).unionByName(changes)
    last = F.row_number().over(Window.partitionBy("policy_id").orderBy(F.desc("version")))
    return rows.withColumn("__n", last).filter("__n = 1 and not deleted").drop("__n", "version", "deleted")


def event_counts(spans: DataFrame, acted: DataFrame) -> DataFrame:
    """(type, action, count) over spans, for an audit event."""
    return spans.join(F.broadcast(acted.select("type", "action")), "type").groupBy("type", "action").agg(F.count("*").alias("count"))


def blocked_types(spans: DataFrame, acted: DataFrame, key: str) -> DataFrame:
    """Documents that a policy blocks, with the sorted types that do so."""
    hits = spans.join(F.broadcast(acted.filter("action = 'block'").select("type")), "type")
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("type")).alias("types"))


def apply(df: DataFrame, spans: str, acted: DataFrame) -> DataFrame:
    """Keeps only spans whose action is mask, and blanks rows with a blocked one (error_code BLOCKED)."""
    table = {r.type: r.action for r in acted.select("type", "action").collect()}  # 24 rows
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    action = lambda s: F.coalesce(F.element_at(known, s["type"]), F.lit(POLICY_DEFAULTS["unknown_entity"]))
    blocked = F.exists(spans, lambda s: action(s) == "block")
    types = F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: action(s) == "block"), lambda s: s["type"])))
    return df.withColumns({"blocked_types": types, "policy_error": F.when(blocked, F.lit("BLOCKED")), spans: F.filter(spans, lambda s: action(s) == "mask")})


ENTITY_COUNT = "struct<type:string,action:string,count:int>"


def enforce(rows: DataFrame, key: str, acted: DataFrame, vault: DataFrame, expires_at: Column, text: str = "text", default: str = POLICY_DEFAULTS["unknown_entity"], now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Applies a policy to masked rows (key, scope, text, mappings of ``mask``): what goes out, and the vault's new rows.

    A row with a blocked type gives no text but its sorted types; else allowed values stand as they
    were and masked ones become the scope's placeholder of that value. Columns: key, out_text,
    issued (placeholders), entities (type, action, count) and blocked_types. Text is put together
    from offsets, so a value that looks like a placeholder is never replaced twice. What has expired
    by ``now`` is not known any more: its value gets a new row and a number of its own. Of several
    live placeholders of one value the one with the largest number, the last given, goes out.
    """
    from maskframe.operators import vault as V

    table = {r.type: r.action for r in acted.select("type", "action").collect()}  # 24 rows
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    action = lambda m: F.coalesce(F.element_at(known, m["type"]), F.lit(default))
    judged = rows.select(key, *V.SCOPE, text, "mappings").withColumn("__m", F.transform("mappings", lambda m: F.struct(m["type"].alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), action(m).alias("action"))))
    blocked = F.array_sort(F.array_distinct(F.transform(F.filter("__m", lambda m: m["action"] == "block"), lambda m: m["type"])))
    judged = judged.withColumn("blocked_types", blocked)
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    seen = judged.filter(F.size("blocked_types") == 0).select(key, *V.SCOPE, F.posexplode("__m").alias("pos", "m")).select(key, *V.SCOPE, "pos", "m.*")
    masked = seen.filter("action = 'mask'").withColumn("composed", nfc(F.col("value")))
    values = masked.select(*V.SCOPE, "type", F.element_at(label, F.col("type")).alias("label"), F.col("composed").alias("value"), F.struct(F.col(key), F.col("pos")).alias("first_seen"))
    fresh = V.intern(vault.select(*V.SCOPE, "type", "value", "placeholder", "expires_at"), values, expires_at, now)
    live = vault if now is None else vault.filter(F.col("expires_at") > now)
    names = live.select(*V.SCOPE, "type", nfc(F.col("value")).alias("composed"), "placeholder").unionByName(fresh.select(*V.SCOPE, "type", F.col("value").alias("composed"), "placeholder"))
    names = names.groupBy(*V.SCOPE, "type", "composed").agg(F.max_by("placeholder", P.number(F.col("placeholder"))).alias("placeholder"))
    parts = masked.join(names, [*V.SCOPE, "type", "composed"], "left").select(key, "start", "end", "type", "action", "placeholder", F.col("placeholder").alias("put"))
    parts = parts.unionByName(seen.filter("action = 'allow'").select(key, "start", "end", "type", "action", F.lit(None).cast("string").alias("placeholder"), F.col("value").alias("put")))
    folded = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "put"))).alias("__p"), F.array_sort(F.collect_set("placeholder")).alias("issued"))
    counts = parts.groupBy(key, "type", "action").agg(F.count("*").cast("int").alias("count")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("type", "action", "count"))).alias("entities"))
    out = judged.join(folded, key, "left").join(counts, key, "left")
    body, empty = F.col(text), F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    woven = F.aggregate(F.coalesce("__p", F.array().cast("array<struct<start:int,end:int,put:string>>")), empty, lambda s, p: F.struct(F.concat(s["out"], F.substring(body, s["at"] + 1, p["start"] - s["at"]), p["put"]).alias("out"), p["end"].alias("at")))
    whole = F.concat(woven["out"], F.substring(body, woven["at"] + 1, F.length(body)))
    return out.select(
        key,
        F.when(F.size("blocked_types") == 0, whole).alias("out_text"),
        F.coalesce("issued", F.array().cast("array<string>")).alias("issued"),
        F.coalesce("entities", F.array().cast(f"array<{ENTITY_COUNT}>")).alias("entities"),
        "blocked_types",
    ), fresh


def full_matrix(rules: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """What keeps rules from being a full matrix, one rule of one type for each type: (type, problem)."""
    named = rules.select("rule_idx", "action", F.size("types").alias("n"), F.explode_outer("types").alias("type"))
    per = named.groupBy("type").agg(F.count("*").alias("rules"), F.max("n").alias("n"), F.count_if(~F.col("action").isin(*ACTIONS)).alias("bad"))
    both = taxonomy.select("type", F.lit(True).alias("known")).join(per, "type", "full")
    problem = F.when(F.col("rules").isNull(), "missing").when(F.col("known").isNull(), "unknown type").when(F.col("rules") > 1, "repeated").when(F.col("n") != 1, "not alone").when(F.col("bad") > 0, "action")
    return both.select("type", problem.alias("problem")).filter("problem is not null")


def listing(policies: DataFrame) -> DataFrame:
    """Policies in the order in which they are tried."""
    return policies.orderBy(F.desc("priority"), "policy_id")


def without_secrets(rows: DataFrame, *secrets: str) -> DataFrame:
    """Keys or providers as they may be shown: secret columns go, and the scan never reads them."""
    return rows.drop(*(secrets or ("secret", "key_hash", "ciphertext")))


def allowed_roles(role: Column, wanted: dict[str, list[str]], permission: Column) -> Column:
    """Whether a role has a permission, by a table of the roles of each."""
    table = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    return F.coalesce(F.array_contains(F.element_at(table, permission), role), F.lit(False))
