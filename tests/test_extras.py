"""Small functions that no registered query covers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from maskframe.functions import generators
from maskframe.functions import recognizers as R
from maskframe.operators import chat, corpus, mask, policy, spans, vault
from maskframe.sources import readers
from maskframe.taxonomy import DETERMINISTIC, TYPES


def test_generated_values_pass_their_own_checks(spark):
    rows = spark.range(60).select(*[generators.value(t, F.col("id"), 7).alias(t) for t in TYPES]).collect()
    for r in rows:
        for t in DETERMINISTIC:
            found = [h for h in R.detect(f"sicil {r[t]} ;", frozenset({t})) if h[0] == t]
            assert found and found[0][1:3] == (6, 6 + len(r[t])), (t, r[t])
    assert len({r.TR_TCKN for r in rows}) == 60
    with pytest.raises(ValueError):
        generators.value("NONE", F.lit(1))


def test_draws_are_exact_and_follow_weights(spark):
    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") < 50, 4.0).otherwise(1.0).alias("weight"))
    for most in (200_000, 60):
        got = corpus.draw(rows, 4000, "s", "id", most=most)
        assert got.count() == 4000 and got.select("draw").distinct().count() == 4000
        heavy = got.filter("id < 50").count()
        assert abs(heavy - 4000 * 200 / 650) < 150
    assert corpus.draw(rows.limit(0), 5, "s", "id").count() == 0 and corpus.draw(rows, 0, "s", "id").count() == 0
    with pytest.raises(ValueError):
        corpus.ordered_union(rows, rows, ("id",))
    assert [r.id for r in corpus.first_rows(rows, "id", 2).collect()] == [0, 1]


def test_policies_of_any_number_equal_trying_all(spark):
    rng = random.Random(4)
    lists = lambda pool: rng.choice([None, [], rng.sample(pool, rng.randint(1, 3))])
    policies = [(f"p{i}", rng.randint(0, 3), lists([1, 2, 3, 4]), lists(["a", "b", "c"])) for i in range(40)]
    contexts = [(i, rng.choice([1, 2, 3, 9, None]), rng.choice(["a", "b", "z", None])) for i in range(60)]

    def best(k, r):
        fits = [p for p in policies if (p[2] is None or k in p[2]) and (p[3] is None or r in p[3])]
        return min(fits, key=lambda p: (-p[1], -(p[2] is not None) - (p[3] is not None), p[0]))[0] if fits else "static"

    kind = "policy_id string, priority int, api_key_ids array<int>, roles array<string>"
    asked = spark.createDataFrame(contexts, "context_id int, api_key_id int, role string")
    got = policy.select(spark.createDataFrame(policies, kind), asked, "static")
    assert {r.context_id: r.policy_id for r in got.collect()} == {i: best(k, r) for i, k, r in contexts}
    assert {r.policy_id for r in policy.select(spark.createDataFrame([], kind), asked, "static").collect()} == {"static"}


def test_enforced_text_keeps_values_that_look_like_placeholders(spark):
    found = [("PERSON", 0, 8, 0.9, "ner"), ("ORG", 9, 12, 0.9, "ner")]
    rows = spark.createDataFrame([(1, "t", "s", "[KISI_2] Koç Ali", found)], f"id int, tenant_id string, session_id string, text string, spans array<{spans.SPAN}>")
    masked = mask.mask(rows, collision="prefix", seed=F.lit("x"))
    acted = spark.createDataFrame([("PERSON", "mask"), ("ORG", "allow")], "type string, action string")
    empty = spark.createDataFrame([], "tenant_id string, session_id string, type string, value string, placeholder string, expires_at timestamp")
    out, fresh = policy.enforce(masked, "id", acted, empty, F.lit("2030-01-01").cast("timestamp"))
    row = out.first()
    assert row.out_text == "[KISI_1] Koç Ali" and row.issued == ["[KISI_1]"] and fresh.first().value == "[KISI_2]"


def test_prefix_suffixes_cannot_be_guessed(spark):
    rows = spark.createDataFrame([("[KISI_1] a@mail.com", [("EMAIL", 9, 19, 0.9, "deterministic")])], f"text string, spans array<{spans.SPAN}>")
    got = {mask.mask(rows, collision="prefix").first().mappings[0].placeholder for _ in range(3)}
    assert len(got) == 3 and all(p.startswith("[EPOSTA_1]#") for p in got)


def test_responses_of_both_shapes(spark):
    block = json.dumps({"content": [{"type": "text", "text": "hi [KISI_1]"}, {"type": "tool_use", "input": {"q": "[KISI_1]"}}], "id": "[KISI_1]"})
    broken = json.dumps({"choices": [{"message": {"content": None, "tool_calls": [{"function": {"arguments": "{[KISI_1]"}}]}}]})
    rows = spark.createDataFrame([(1, block), (2, "no json"), (3, None), (4, broken)], "id int, body string")
    got = {r.id: r.r for r in rows.select("id", chat.restore_response(F.col("body"), F.create_map(F.lit("[KISI_1]"), F.lit("Ali"))).alias("r")).collect()}
    value = json.loads(got[1])
    assert value["content"][0]["text"] == "hi Ali" and value["content"][1]["input"] == {"q": "Ali"} and value["id"] == "[KISI_1]" and got[2] is None and got[3] is None
    assert json.loads(got[4])["choices"][0]["message"]["tool_calls"][0]["function"]["arguments"] == "{Ali"
    parts = chat.response_segments(rows.filter("id = 1"), "id", shape="anthropic").collect()
    assert [(r.path, r.text) for r in parts] == [("response.content.part.0", "hi [KISI_1]")]
    call = json.dumps({"choices": [{"message": {"content": "a", "tool_calls": [{"function": {"arguments": '{"x":["b"]}'}}]}}]})
    parts = chat.response_segments(spark.createDataFrame([(1, call)], "id int, body string"), "id").collect()
    assert sorted((r.path, r.text) for r in parts) == [("response.0.content", "a"), ("response.0.tool.0.x.0", "b")]
    items, known = spark.createDataFrame([(1, "a"), (1, "b")], "r int, id string"), spark.createDataFrame([(1, "a")], "r int, id string")
    assert [r.id for r in chat.unanswered(items, known, "r").collect()] == ["b"]


def test_reports_locks_and_conversion(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"strict": {"per_type": {"EMAIL": {"tp": 1, "fp": 2, "fn": 3, "support": 4}}}}, indent=1))
    got = readers.read_reports(spark, f"{tmp_path}/*.json")
    assert got.count() == 2 and got.first().support == 4
    (tmp_path / "k6").write_text(json.dumps({"metrics": {"http_req_duration": {"p(95)": 9.85}}}))
    assert readers.read_load_summary(spark, str(tmp_path / "k6"), "http_req_duration").first().p95 == 9.85
    gold = tmp_path / "gold"
    gold.write_text("".join(json.dumps({"id": str(i), "text": "mail at now", "entities": [{"type": "EMAIL", "start": 5, "end": 7, "text": "at"}]}) + "\n" for i in range(3)))
    one = readers.convert_examples(spark, str(gold), str(tmp_path / "out"), limit=2).first()
    two = readers.convert_examples(spark, str(gold), str(tmp_path / "again"), limit=2).first()
    assert one.n == 2 and one.sha256 == two.sha256 and readers.read_prepared(spark, str(tmp_path / "out")).first().ner[0].label == "EMAIL"
    scores = spark.createDataFrame([("EMAIL", 0.5), ("ORG", 0.25)], "type string, recall double")
    readers.write_report(scores, str(tmp_path / "r"))
    assert json.loads((tmp_path / "r.json").read_text())[0]["type"] == "ORG" and (tmp_path / "r.md").read_text().startswith("| type | recall |")
    readers.append_lines(scores, str(tmp_path / "log"))
    readers.append_lines(scores, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_settings_and_registry(tmp_path):
    schema = {"PORT": (int, 80, 1, 65535), "KEY": (str, None, None, None)}
    assert readers.config({"M_KEY": "k", "OTHER": "x"}, schema, "M_") == {"PORT": 80, "KEY": "k"}
    for bad in ({"M_KEY": "k", "M_NEW": "x"}, {}, {"M_KEY": "k", "M_PORT": "0"}):
        with pytest.raises(ValueError):
            readers.config(bad, schema, "M_")
    pytest.importorskip("yaml")
    path = tmp_path / "models.yaml"
    path.write_text(f"models:\n- id: a\n  revision: '{'0' * 40}'\n  files: [{{size: 3, sha256: {'a' * 64}}}]\n- id: b\n  revision: main\n")
    assert readers.model_entry(str(path), "a")["files"][0]["size"] == 3
    for bad in ("b", "c"):
        with pytest.raises(ValueError):
            readers.model_entry(str(path), bad)


def test_listings_and_roles(spark):
    rows = spark.createDataFrame([("b", 1, "x"), ("a", 1, "y"), ("c", 5, "z")], "policy_id string, priority int, secret string")
    assert [r.policy_id for r in policy.listing(rows).collect()] == ["c", "a", "b"] and policy.without_secrets(rows).columns == ["policy_id", "priority"]
    allowed = policy.allowed_roles(F.col("r"), {"read": ["admin", "auditor"]}, F.col("p"))
    got = spark.createDataFrame([("admin", "read"), ("user", "read"), ("admin", "write"), (None, "read")], "r string, p string").select(allowed).collect()
    assert [r[0] for r in got] == [True, False, False, False]
    assert spans.model_threshold({"A": 0.4}, 0.5) == 0.2


def test_sealed_rows_and_their_audit_events(spark):
    rows = spark.createDataFrame([("t", "s", "PERSON", "Ali", "[KISI_1]"), ("t", "s", "EMAIL", "a@b.co", "[EPOSTA_1]")], "tenant_id string, session_id string, type string, value string, placeholder string").withColumn("expires_at", F.lit("2030-01-01").cast("timestamp"))
    key, iv = F.unhex(F.lit("00" * 16)), F.unhex(F.lit("01" * 12))
    stored, events = vault.seal(rows, key, iv, "secret")
    assert "value" not in stored.columns and {r.value for r in vault.unseal(stored, key).collect()} == {"Ali", "a@b.co"}
    assert {r.value for r in vault.unseal(stored.withColumn("session_id", F.lit("other")), key).collect()} == {None}
    event = events.first()
    assert event.actor == "api-key:t" and [tuple(e) for e in event.entities] == [("EMAIL", "mask", 1), ("PERSON", "mask", 1)]
    wanted = stored.filter("placeholder = '[KISI_1]'").select("tenant_id", "session_id", F.col("entity_type").alias("type"), "value_hmac")
    assert vault.by_digest(rows, wanted, "secret").first().placeholder == "[KISI_1]"


def test_rows_of_both_shapes_are_read_from_one_path(spark, tmp_path):
    path = tmp_path / "x"
    path.write_text(json.dumps({"id": "g", "text": "mail at now", "entities": [{"type": "EMAIL", "start": 5, "end": 7, "text": "at"}]}) + "\n" + json.dumps({"id": "p", "source": "s", "tokenized_text": ["mail", "at", "now"], "ner": [[1, 1, "EMAIL"]], "ner_labels": ["EMAIL"]}) + "\n")
    got = {r.id: (r.text, [tuple(e) for e in r.entities]) for r in readers.read_examples(spark, str(path)).collect()}
    assert got == {k: ("mail at now", [("EMAIL", 5, 7, "at")]) for k in "gp"}


def test_the_taxonomy_is_closed_and_health_is_told(spark):
    from maskframe.operators import benchmark, detect

    rows = spark.createDataFrame([("Ayşe geldi",)], "text string")
    assert detect.analyze(rows, model=detect.lexicon_model({"Ayşe": "PERSON"})).first().spans[0].type == "PERSON"
    with pytest.raises(Exception, match="unknown type"):
        detect.analyze(rows, model=detect.lexicon_model({"Ayşe": "HUMAN"})).collect()
    assert benchmark.health(spark).first().ready and not benchmark.health(spark, False).first().ready


def test_pilot_runs_on_the_right_device(spark):
    from maskframe.operators import evaluate

    good = ("pilot", False, False, 500, 500, "max-steps", 0.5, 0.4, 1 << 30, "bf16", True)
    rows = spark.createDataFrame([("a", *good, "NVIDIA A100-SXM4"), ("b", *good, "other"), ("c", *good, None)], "run string, run_kind string, complete boolean, adoption_eligible boolean, max_steps int, optimizer_steps int, stop_reason string, mean_loss double, final_loss double, peak_bytes long, amp string, development_gate_pass boolean, gpu_name string")
    assert {r.run: r.reasons for r in evaluate.pilot_gate(rows).collect()} == {"a": [], "b": ["device"], "c": ["device"]}
    assert {r["pass"] for r in evaluate.pilot_gate(rows.drop("gpu_name")).collect()} == {True}
