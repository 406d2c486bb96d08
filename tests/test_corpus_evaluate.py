import hashlib
import json

import pytest
from pyspark.sql import functions as F

from maskframe.operators import corpus, evaluate
from maskframe.sources import readers
from maskframe.taxonomy import POLICY_RULES

SPANS = "doc_id long, type string, start int, end int"


def counts(df):
    return {r.type: (r.tp, r.fp, r.fn, r.support) for r in df.collect()}


def test_strict_and_partial_differ(spark):
    gold = spark.createDataFrame([(1, "A", 4, 14), (1, "A", 20, 30), (2, "B", 0, 5)], SPANS)
    pred = spark.createDataFrame([(1, "A", 4, 12), (1, "A", 20, 30), (1, "A", 20, 30), (3, "C", 0, 1)], SPANS)
    assert counts(evaluate.strict(gold, pred)) == {"A": (1, 2, 1, 2), "B": (0, 0, 1, 1), "C": (0, 1, 0, 0)}
    assert counts(evaluate.partial(gold, pred)) == {"A": (2, 1, 0, 2), "B": (0, 0, 1, 1), "C": (0, 1, 0, 0)}


def test_partial_is_one_to_one_in_order(spark):
    gold = spark.createDataFrame([(1, "A", 0, 10)], SPANS)
    pred = spark.createDataFrame([(1, "A", 0, 3), (1, "A", 5, 9)], SPANS)
    assert counts(evaluate.partial(gold, pred)) == {"A": (1, 1, 0, 1)}


def test_zero_denominators_and_averages(spark):
    c = spark.createDataFrame([("A", 0, 0, 0, 0), ("B", 1, 1, 0, 1), ("C", 0, 0, 2, 2)], "type string, tp long, fp long, fn long, support long")
    s = {r.type: (r.precision, r.recall, r.f1) for r in evaluate.with_scores(c).collect()}
    assert s["A"] == (0, 0, 0) and s["B"] == (0.5, 1, 2 / 3)
    assert evaluate.macro(c).first().recall == 0.5
    assert evaluate.micro(c).first().recall == pytest.approx(1 / 3)
    assert counts(evaluate.combine(c, c))["B"] == (2, 2, 0, 2)


def test_sweep_equals_one_pass_per_threshold(spark):
    rows = [(i % 2, (i * 37 % 10) / 10) for i in range(40)]
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluate.sweep(spark.createDataFrame(rows, "y int, s double"), [0.0, 0.3, 0.95], "y", "s").collect()}
    assert got == {t: (sum(s >= t and y for y, s in rows), sum(s >= t and not y for y, s in rows), sum(s < t and y for y, s in rows)) for t in (0.0, 0.3, 0.95)}


def test_verdicts_and_gate(spark):
    f = lambda *xs: spark.createDataFrame(list(xs), "type string, f1 double")
    good = evaluate.verdict(f(("A", 0.9), ("B", 0.8)), f(("A", 0.7), ("B", 0.81))).first()
    assert good.adopt and good.reasons == ["adoption rule is met"]
    worse = evaluate.verdict(f(("A", 0.99), ("B", 0.7)), f(("A", 0.7), ("B", 0.75))).first()
    assert not worse.adopt and worse.regressions == ["B"]
    assert not evaluate.verdict(f(("A", 0.9)), f(("A", 0.5)), eligible=False).first().adopt
    assert not evaluate.verdict(f(("A", 0.9)), f(("A", 0.5)), empty_fp=(3, 2)).first().adopt
    scores = spark.createDataFrame([("A", 1.0, 0.995, 5), ("B", 0.99, 0.5, 5)], "type string, precision double, recall double, support int")
    assert {r.type: r.reasons for r in evaluate.gate(scores, ["A", "B", "C"]).collect()} == {"B": "precision, recall", "C": "no support"}


def test_empty_gold_and_best_run(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    gold, pred = spark.createDataFrame([(1, "A", 0, 1)], SPANS), spark.createDataFrame([(2, "A", 0, 1), (2, "A", 2, 3)], SPANS)
    assert tuple(evaluate.empty_gold(docs, gold, pred).first()) == (2, 1, 2)
    runs = spark.createDataFrame([("a", 1, 5), ("b", 2, 1)], "run string, x int, y int")
    assert evaluate.best_run(runs, "x", "y").first().run == "b"


def test_generate_render_and_gold_reader(spark, tmp_path):
    templates = spark.createDataFrame([(0, "t0", "d", "{PERSON} lives in {ADDRESS}."), (1, "t1", "d", "no slot")], "row int, template_id string, domain string, pattern string")
    rows = corpus.generate(templates, 2)
    assert sorted((r.row, r.morphology) for r in rows.collect()) == [(0, "plain"), (1, "ascii"), (2, "ascii"), (3, "lower")]
    values = rows.select("row", F.explode(F.array(F.struct(F.lit("PERSON").alias("type"), corpus.value_of(F.col("row"), "PERSON", ["Ayşe", "Ali"]).alias("value")), F.struct(F.lit("ADDRESS").alias("type"), F.lit("İzmir").alias("value")))).alias("v")).select("row", "v.*")
    made = corpus.render(rows, values)
    made.select(F.col("row").cast("string").alias("id"), "domain", "template_id", F.array("morphology").alias("morphology"), "text", "entities").coalesce(1).write.json(str(tmp_path / "gold"))
    gold = readers.read_gold(spark, str(tmp_path / "gold"))
    assert gold.count() == 4 and gold.filter(F.size("entities") == 2).count() == 2
    assert readers.read_examples(spark, str(tmp_path / "gold")).count() == 4
    bad = tmp_path / "bad.jsonl"
    bad.write_text(json.dumps({"id": "1", "text": "abc", "entities": [{"type": "A", "start": 0, "end": 2, "text": "xx"}]}))
    assert readers.read_gold(spark, str(bad), strict=False).first().error_code == "BAD_ENTITY"
    with pytest.raises(Exception, match="BAD_ENTITY"):
        readers.read_gold(spark, str(bad)).collect()


def test_prepare_and_rebuild(spark, tmp_path):
    rows = spark.createDataFrame([("1", "s", "Ayşe Can, İzmir'de.", [("PERSON", 0, 8), ("ADDRESS", 10, 15), ("ORG", 1, 3)])], "id string, source string, text string, entities array<struct<type:string,start:int,end:int>>")
    r = corpus.prepare(rows).first()
    assert r.tokenized_text == ["Ayşe", "Can", ",", "İzmir", "'", "de", "."]
    assert [tuple(x) for x in r.ner] == [(0, 1, "PERSON"), (3, 3, "ADDRESS")] and r.misaligned == 1
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps({"id": "1", "source": "s", "tokenized_text": r.tokenized_text, "ner": [[0, 1, "PERSON"]], "ner_labels": ["PERSON"]}, ensure_ascii=False))
    back = readers.read_examples(spark, str(path)).first()
    assert [tuple(e) for e in back.entities] == [("PERSON", 0, 8, "Ayşe Can")]


def test_external_corpus(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    mask = [{"value": "Ali", "start": 0, "end": 3, "label": "firstname"}, {"value": "zz", "start": 0, "end": 2, "label": "CITY"}, {"value": "geldi", "start": 4, "end": 9, "label": "VERB"}]
    path.write_text("\n".join(json.dumps({"source_text": "Ali geldi", "language": lang, "privacy_mask": mask}) for lang in ("tr", "en")))
    rows = readers.read_external(spark, str(path)).collect()
    assert len(rows) == 1 and [tuple(e) for e in rows[0].entities] == [("PERSON", 0, 3, "Ali")]


def test_isolation_and_sets(spark):
    a, b = spark.createDataFrame([("x", "1"), ("y", "2")], "text string, id string"), spark.createDataFrame([("y", "3")], "text string, id string")
    assert [r.text for r in corpus.overlap(a, b, "text").collect()] == ["y"]
    corpus.assert_isolated(a, b, ("id",))
    with pytest.raises(ValueError):
        corpus.assert_isolated(a, b, ("text",))
    assert corpus.same_set(a, a).count() == 0 and corpus.same_set(a, b).count() == 3
    assert corpus.duplicates(a.unionByName(a), corpus.fingerprint("text")).count() == 2


def test_weights_and_sampling(spark):
    rows = spark.createDataFrame([(1, ["A"]), (2, ["A"]), (3, ["A", "B"]), (4, [])], "id long, labels array<string>")
    w = {r.id: r.weight for r in corpus.label_weights(rows, "id", "labels").collect()}
    assert w == {1: 1.0, 2: 1.0, 3: 3.0, 4: 0.25}
    weighted = corpus.label_weights(spark.range(4000).select("id", F.array(F.when(F.col("id") % 10 == 0, "B").otherwise("A")).alias("labels")), "id", "labels")
    one, two = (sorted((r.id, r.draw) for r in corpus.sample(weighted, 4000, 1, e, "id").collect()) for e in (0, 0))
    assert one == two and abs(len(one) - 4000) < 200
    assert abs(sum(i % 10 == 0 for i, _ in one) / len(one) - 4 / 13) < 0.03
    q = {r.source: r.side_quota for r in corpus.replay_quota(spark.createDataFrame([("a",), ("a",), ("b",)], "source string"), "source", F.col("source") == "a", 0.7).collect()}
    assert q == {"a": 2, "b": 1}


def test_bundle_digests_and_configuration(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    d = readers.digests(spark, str(tmp_path / "f")).first()
    assert (d.length, d.sha256[:8]) == (3, "ba7816bf")
    listed, found = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert {tuple(r) for r in readers.check_bundle(listed, found).collect()} == {("b", "differs"), ("c", "missing"), ("d", "unlisted")}
    (tmp_path / "p.yaml").write_text("version: 1\ndefaults: {unknown_entity: block}\nrules:\n- match: {types: [ORG]}\n  action: allow\n")
    assert readers.load_policy(str(tmp_path / "p.yaml"))[0] == [{"types": ["ORG"], "action": "allow"}]
    (tmp_path / "q.yaml").write_text("version: 1\nextra: 1\nrules: []\n")
    with pytest.raises(ValueError):
        readers.load_policy(str(tmp_path / "q.yaml"))
    assert len(POLICY_RULES) == 5


def test_frames(spark, tmp_path):
    (tmp_path / "s.txt").write_bytes(b"event: a\r\ndata: 1\r\n\r\ndata: 2\ndata: 3\n\n")
    assert [(r.seq, r.event, r.data) for r in readers.read_frames(spark, str(tmp_path / "s.txt")).orderBy("seq").collect()] == [(0, "a", "1"), (1, "", "2\n3")]


def test_digest_has_two_levels_whatever_the_number_of_rows(spark):
    blocks = [hashlib.sha256("\n".join(hashlib.sha256(f'{{"id":{1000 * b + i}}}'.encode()).hexdigest() for i in (1, 2)).encode()).hexdigest() for b in range(1500)]
    rows = spark.range(1500).select(F.explode(F.array(F.col("id") * 1000 + 2, F.col("id") * 1000 + 1)).alias("id"))
    assert corpus.ordered_digest(rows, "id", "id").first().sha256 == hashlib.sha256("\n".join(blocks).encode()).hexdigest()
    assert corpus.ordered_digest(rows.limit(0), "id", "id").first().sha256 is None
