from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskframe.operators import chat, detect, mask, policy, spans
from maskframe.taxonomy import taxonomy

SPAN = "array<struct<type:string,start:int,end:int,confidence:double,layer:string>>"


def span(kind, a, b):
    return {"type": kind, "start": a, "end": b, "confidence": 1.0, "layer": "ner"}


def test_repeated_values_share_a_placeholder():
    text = "Ayşe aradı, Ayşe yazdı, Ali."
    masked, mappings = mask.splice(text, [span("PERSON", 0, 4), span("PERSON", 12, 16), span("PERSON", 24, 27)])
    assert masked == "[KISI_1] aradı, [KISI_1] yazdı, [KISI_2]."
    assert [m["value"] for m in mappings] == ["Ayşe", "Ayşe", "Ali"]


def test_counters_run_per_label():
    masked, _ = mask.splice("AB", [span("TR_IBAN", 0, 1), span("IBAN_OTHER", 1, 2)])
    assert masked == "[IBAN_1][IBAN_2]"


def test_canonically_equal_values_are_one():
    masked, _ = mask.splice("é é", [span("PERSON", 0, 1), span("PERSON", 2, 4)])
    assert masked == "[KISI_1] [KISI_1]"


def test_mask_golden_and_errors(spark):
    rows = [("Müşteri 👩 TCKN 10000000146 IBAN TR330006100519786457841326",), ("Önceden [KISI_1] var",), (None,), ("",), ("plain",)]
    df = spark.createDataFrame(rows, "text string").withColumn("a.b", F.lit(1))
    out = mask.mask(detect.analyze(df, types=["TR_TCKN", "TR_IBAN"])).collect()
    assert out[0].masked_text == "Müşteri 👩 TCKN [TCKN_1] IBAN [IBAN_1]"
    assert [(m.start, m.end) for m in out[0].mappings] == [(15, 26), (32, 58)]
    assert (out[1].masked_text, out[1].error_code) == (None, "PLACEHOLDER_COLLISION")
    assert out[2].masked_text is None and out[3].masked_text == "" and out[4].masked_text == "plain"
    suffixed = mask.mask(spark.createDataFrame([("[KISI_1] 10000000146", [span("TR_TCKN", 9, 20)])], f"text string, spans {SPAN}"), collision="prefix", seed=F.lit("s"))
    first = suffixed.first()
    assert first.masked_text.startswith("[KISI_1] [TCKN_1]#") and len(first.masked_text) == 9 + 9 + 16 + 0
    assert mask.unmask(suffixed).first().text_restored == "[KISI_1] 10000000146"
    assert mask.mask(suffixed.select("text", "spans"), collision="prefix", include_values=False).first().mappings[0].value is None


def test_bad_spans_are_errors(spark):
    rows = [("abc", [span("PERSON", 0, 9)]), ("abc", [span("PERSON", 2, 3), span("PERSON", 0, 1)]), ("abc", [span("NOPE", 0, 1)])]
    out = mask.mask(spark.createDataFrame(rows, f"text string, spans {SPAN}")).collect()
    assert [r.error_code for r in out] == ["BAD_SPANS", "BAD_SPANS", "UNKNOWN_TYPE"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["Ayşe", "İ", "i̇", "👩‍💻", " ", "\n", "10000000146", "a@b.co", "ß", "é"]), max_size=10))
def test_round_trip(pieces):
    text = "".join(pieces)
    masked, mappings = mask.splice(text, mask.resolved(text))
    assert mask.restore(masked, {m["placeholder"]: m["value"] for m in mappings}) == text


def test_unknown_placeholders_stay():
    assert mask.restore("[KISI_1] [KISI_2]", {"[KISI_1]": "A"}) == "A [KISI_2]"


def test_numbering_matches_splice(spark):
    rows = spark.createDataFrame([(1, "EMAIL", "EPOSTA", 9, "b"), (1, "EMAIL", "EPOSTA", 2, "a"), (1, "EMAIL", "EPOSTA", 20, "a")], "doc long, type string, label string, start int, value string")
    assert {(r.value, r.placeholder) for r in mask.numbering(rows, "doc").collect()} == {("a", "[EPOSTA_1]"), ("b", "[EPOSTA_2]")}


def test_budgets(spark):
    rows = spark.createDataFrame([(1, "a", "x" * 10), (1, "a", "y"), (2, "b", "z")], "req int, id string, text string")
    assert [(r.req, r.reasons) for r in mask.budget_errors(rows, "req", max_item=5).collect()] == [(1, ["repeated ids", "item too long"])]


def test_policy(spark):
    acted = policy.actions(taxonomy(spark), policy.rules_table(spark))
    table = {r.type: r.action for r in acted.collect()}
    assert len(table) == 24 and table["DOB"] == "block" and table["CREDIT_CARD"] == "mask" and table["ORG"] == "allow" and table["UNION"] == "block"
    # Rules that name types come before rules that name classes, whatever their order.
    both = policy.actions(taxonomy(spark), policy.rules_table(spark, [{"kvkk_class": "general", "action": "block"}, {"types": ["EMAIL"], "action": "allow"}]))
    assert {r.type: r.action for r in both.collect()}["EMAIL"] == "allow"
    df = spark.createDataFrame([("a", [span("EMAIL", 0, 1), span("ORG", 1, 2)]), ("b", [span("HEALTH", 0, 1)])], f"id string, s {SPAN}")
    out = {r.id: r for r in policy.apply(df, "s", acted).collect()}
    assert [s.type for s in out["a"].s] == ["EMAIL"] and out["a"].policy_error is None
    assert out["b"].policy_error == "BLOCKED" and out["b"].blocked_types == ["HEALTH"]


def test_policy_selection_and_upsert(spark):
    shape = "policy_id string, priority int, api_key_ids array<int>, roles array<string>"
    policies = spark.createDataFrame([("role", 10, None, ["admin"]), ("top", 100, None, None), ("none", 500, [], None)], shape)
    contexts = spark.createDataFrame([(1, 7, "admin"), (2, None, None)], "context_id int, api_key_id int, role string")
    assert [(r.context_id, r.policy_id) for r in policy.select(policies, contexts).orderBy("context_id").collect()] == [(1, "top"), (2, "top")]
    changes = spark.createDataFrame([("top", 1, None, None, 1, False), ("role", 0, None, None, 1, True)], shape + ", version long, deleted boolean")
    assert {(r.policy_id, r.priority) for r in policy.upsert(policies, changes).collect()} == {("top", 1), ("none", 500)}


def test_unknown_types(spark):
    rows = spark.createDataFrame([("EMAIL",), ("NOPE",)], "type string")
    assert [r.type for r in spans.unknown_types(rows, taxonomy(spark)).collect()] == ["NOPE"]


def test_chat_segments_and_json(spark):
    body = '{"model":"m","system":"S","messages":[{"role":"user","name":"N","content":"hi"},{"role":"user","content":[{"type":"text","text":"a"},{"type":"text","text":"b"},{"type":"image_url"},{"type":"text","text":"c"}]}],"odd":1}'
    df = spark.createDataFrame([("r", body)], "req_id string, body string")
    got = {(r.path, r.text) for r in chat.request_segments(df).collect()}
    assert got == {("system", "S"), ("messages.0.name", "N"), ("messages.0.content", "hi"), ("messages.1.content.part.0", "ab"), ("messages.1.content.part.3", "c")}
    assert df.select(chat.unknown_keys(F.col("body"))).first()[0] == ["odd"]
    docs = spark.createDataFrame([('{"a":["[KISI_1]",{"b":"x"}]}',), ("no json",), (None,)], "d string")
    assert [None if r[0] is None else [(x.path, x.text) for x in r[0]] for r in docs.select(chat.json_strings(F.col("d"))).collect()] == [[("a.0", "[KISI_1]"), ("a.1.b", "x")], None, None]
    restored = docs.select(chat.restore_json(F.col("d"), F.create_map(F.lit("[KISI_1]"), F.lit('A"q')))).collect()
    assert restored[0][0] == '{"a":["A\\"q",{"b":"x"}]}' and restored[1][0] is None
    parts = spark.createDataFrame([("text",), ("video",), (None,)], "type string")
    assert chat.unsupported(parts).count() == 2
