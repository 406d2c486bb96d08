import random
from collections import Counter

import pytest

from maskframe.functions import phrases as A
from maskframe.operators import corpus
from maskframe.plans import catalogue

SF = "/root/testdata/sf0.001"


def brute(docs, items):
    return Counter((i, d) for i, p in items for d, t in docs if p is not None and t is not None and p in t)


@pytest.mark.parametrize("phrase_bytes", [4 << 20, 5])
def test_contained_equals_brute_force(spark, phrase_bytes):
    docs = [(1, "the quick brown fox"), (2, "bathe quick brown foxes"), (2, "bathe quick brown foxes"), (3, ""), (4, None), (None, "a  b  c"), (5, "quick\nbrown the")]
    items = [("a", "the quick brown fox"), ("a", "the quick brown fox"), ("b", "he quick b"), ("c", "quick"), ("d", ""), ("e", None), ("f", "a  b"), ("g", "no such text here"), (None, "k brown f"), ("h", "  "), ("i", "quick\nbrown"), ("j", " brown ")]
    got = corpus.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), "doc_id", "text", "item_id", "text", phrase_bytes)
    assert got.columns == ["item", "doc_id"] and Counter(tuple(r) for r in got.collect()) == brute(docs, items)


def test_isolation_semi_over_a_large_benchmark(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    other = [(1000 + i, f"item {i} of a benchmark " + f"word{i} " * 60) for i in range(9000)]
    assert sum(len(t) for _, t in other) > 4 << 20
    spark.createDataFrame(items + other, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(tuple(r) for r in catalogue.QUERIES["isolation_semi"](spark, str(tmp_path)).collect())
    assert got and got == brute([tuple(r) for r in docs.collect()], items)


@pytest.mark.parametrize("segment", [4096, 1])
def test_automaton_against_containment(monkeypatch, segment):
    monkeypatch.setattr(A, "SEGMENT", segment)
    draw = random.Random(2)
    word = lambda n, letters: bytes(draw.choice(letters) for _ in range(n))
    phrases = list({word(draw.randint(1, 9), b"ab") for _ in range(200)} | {word(30, b"abc") for _ in range(20)} | {b"aaaa", b"aa", b"a", "é".encode()})
    texts = [word(draw.randint(0, 300), b"abc") for _ in range(60)] + [b"", b"a" * 5000, phrases[0], "caf\u00e9".encode(), b"b" * 2000 + phrases[1] + b"c" * 4100]
    where, which = A.Phrases(phrases).find(texts)
    assert sorted(zip(where.tolist(), which.tolist())) == [(i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if p in t]
    none = A.Phrases([])
    assert len(none.find(texts)[0]) == 0 and len(A.Phrases(phrases).find([])[0]) == 0


def test_one_plan_for_any_number_of_items(spark):
    docs = spark.createDataFrame([(i, f"text {i} end") for i in range(50)], "doc_id long, text string")
    for n in (3, 1200):
        items = spark.createDataFrame([(i, f"text {i} e") for i in range(n)], "item_id long, text string")
        got = corpus.contained(docs, items, "doc_id", "text", "item_id", "text")
        assert sorted((r.item, r.doc_id) for r in got.collect()) == [(i, i) for i in range(min(n, 50))]
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
