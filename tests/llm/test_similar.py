"""Near-duplicates against the exact Jaccard similarity of shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.llm import similar, simhash
from maskframe.llm._common import materialize

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, least=0.8):
    """Smallest id reachable over pairs of ``least`` similarity, of each row; None where no row has one."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                root[find(i)] = find(j)
    name = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            name[find(i)] = min(name.get(find(i), k), k)
    return [name.get(find(i)) for i in range(len(rows))]


def edited(rng, words, edits):
    """``words`` with runs replaced, far apart, so that each replaced word takes five shingles."""
    out = list(words)
    for at in rng.sample(range(0, len(words) - 5, 6), edits):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def pairs(n=12):
    """Texts of 200 words and copies of about 0.65 to 0.9 similarity."""
    rng = random.Random(5)
    texts = []
    for edits in (2, 3, 4, 5, 6, 7, 8):
        for _ in range(n):
            words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
            texts += [" ".join(words), edited(rng, words, edits)]
    return list(enumerate(texts))


def test_pipeline_drops_only_texts_of_the_required_similarity(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = pairs()
    sure = [jaccard(shingles(rows[i][1]), shingles(rows[i + 1][1])) for i in range(0, len(rows), 2)]
    assert sum(x >= 0.8 for x in sure) > 20 and sum(0.6 < x < 0.8 for x in sure) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(brute(rows)))


@pytest.mark.parametrize("group", [2048, 3])
def test_components_equal_exact_jaccard(spark, monkeypatch, group):
    monkeypatch.setattr(similar, "GROUP", group)
    monkeypatch.setattr(simhash, "BUCKET", 20 if group == 3 else 16384)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    chain = [" ".join(base[i : i + 120]) for i in range(0, 30, 3)]  # neighbours are similar, ends are not
    dense = [edited(rng, [f"d{i}" for i in range(150)], k % 9) for k in range(40)]
    line = "the same five words here " * 300
    weights = [line + " ".join(f"{c}{i}" for i in range(60)) for c in "xy"]  # one line outweighs what differs
    odd = ["", " ", "one", "One ", "a b c d e", "a b c d e f", "A  b c d e f", "Two words", "p q r s t u v w", "p q r s t u v w x"]
    texts = [*chain, *dense, *weights, *odd, weights[0] + " end", chain[0]]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, chain[3]), (3, "another text under an id that is taken"), (None, "one"), (None, None), (None, "nobody has these five words"), (None, "nobody has these five words")]
    df = materialize(spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate(rows)], "n long, doc_id long, text string"), "rows")
    got = {r.node: r.component for r in similar.near_duplicates(df, "n").collect()}
    want = brute(rows)
    assert [rows[c][0] for c in got.values()] == [want[n] for n in got]
    # One group for each different name, and one for the rows that no id names.
    assert len(set(got.values())) == len({(w, 0) if w is not None else (None, t) for w, (_, t) in zip(want, rows, strict=True)})
    assert similar.near_duplicates(materialize(df.limit(0), "rows"), "n").count() == 0


def test_one_row_of_each_group_stays(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, x = "the first text has these seven words", "quite another text with some other words"
    for rows, want in (
        ([(5, a), (7, a), (7, x)], [(5, a), (7, x)]),
        ([(None, a), (None, a), (None, x)], [(None, a), (None, x)]),
        ([(None, a), (3, a), (3, a), (2, x)], [(2, x), (3, a)]),
        ([(1, None), (2, ""), (3, " ")], [(1, None)]),
        ([], []),
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "c0": F.lit(2)})
        got = corpus_pipeline.near_duplicates(spark, docs, SF)
        assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("low,high,recall", [(0.8, 0.83, 0.99), (0.83, 0.9, 1), (0.9, 1, 1)])
def test_recall_by_similarity(spark, low, high, recall):
    """Pairs of every band of similarity are found, nothing below 0.8 is."""
    rows = pairs(40)
    df = materialize(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, doc_id long, text string"), "rows")
    root = {r.node: r.component for r in similar.near_duplicates(df, "n").collect()}
    similarity = [(i, jaccard(shingles(rows[i][1]), shingles(rows[i + 1][1]))) for i in range(0, len(rows), 2)]
    within = [i for i, s in similarity if low <= s < high]
    assert within and sum(root[i] == root[i + 1] for i in within) >= recall * len(within)
    assert all(root[i] != root[i + 1] for i, s in similarity if s < 0.8)


def test_sets_are_compared_exactly():
    sets = [np.arange(a, b, dtype=np.uint64) for a, b in ((0, 8), (0, 10), (3, 10), (20, 28), (0, 0), (0, 0))]
    bits = np.zeros((6, 4), dtype=np.uint64)
    assert similar.link_sets(bits, sets, 72, 0.8).tolist() == [0, 0, 2, 3, 4, 4]
    assert similar.link_sets(bits, sets, 72, 0.7).tolist() == [0, 0, 0, 3, 4, 4]
    assert similar.link_sets(bits, [sets[0], sets[1], sets[0]], 72, 0.8, half=1).tolist() == [0, 0, 0]
    bits[1] = ~bits[1]
    assert similar.link_sets(bits, sets, 72, 0.8).tolist() == [0, 1, 2, 3, 4, 4]
