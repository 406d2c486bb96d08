"""Operators over whole corpora, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from maskframe.llm import decontaminate, shards, simhash, suffix_dedup
from maskframe.llm._common import shared_dir
from maskframe.llm._tokens import mix

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "one", "Two  words", "two words", "x" * 3000, "ab" * 400, "\n\n", "İ 👩‍💻 ß é", "tie tie tie tie", "tie tie tie tie"]


def frame(spark, texts):
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(0, texts[0] if texts else None, "y", None)] * bool(texts)
    return spark.createDataFrame(rows, "doc_id long, text string, `n.words` string, items int")


def sample(spark, n=80):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()] + ODD


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def edges(n=30):
    """Texts that share a passage between words of their own, so that segments at its edges differ."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(90))
    own = lambda: " ".join(f"q{rng.randint(0, 10**9)}" for _ in range(40))
    return [f"{own()} {passage} {own()}" for _ in range(n)]


@pytest.mark.parametrize("block_bytes,hot,per_anchor", [(1 << 23, 2048, 16), (30_000, 2048, 16), (30_000, 4, 16), (30_000, 2048, 1), (9_000, 1, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, block_bytes, hot, per_anchor):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 50_000)
    monkeypatch.setattr(suffix_dedup, "PER_ANCHOR", per_anchor)
    texts = [*sample(spark, 60), *edges(), *edges(2)[:1] * 3]
    df = frame(spark, texts).repartition(3)
    want = brute_repeats([*texts, texts[0]], suffix_dedup.LENGTH)
    got = suffix_dedup.repeated(df, block_bytes=block_bytes, hot=hot).collect()
    assert sorted((r.doc_id, *tuple(r)[1:]) for r in got) == sorted((i % len(texts), *w) for i, w in enumerate(want))


def removed(texts, **more):
    """n_removed of texts, each its own block, without Spark."""
    blocks = [suffix_dedup.Block([t.encode()], 200, 128) for t in texts]
    batch = lambda rows: pa.Table.from_batches(rows)
    asked = batch([suffix_dedup.ask_segments(i, b, 1) for i, b in enumerate(blocks)])
    answers = list(suffix_dedup.judge_segments(0, asked, more.get("hot", 2048)))
    of = lambda i: batch([x for x in answers if x.column("block")[0].as_py() == i] or [answers[0].slice(0, 0)])
    sent = batch([r for i, b in enumerate(blocks) for r in suffix_dedup.send_candidates(i, b, suffix_dedup._told(of(i), 0, b.anchors, 1), 1)])
    answers += suffix_dedup.judge_candidates(0, sent, 200)
    return [int(suffix_dedup.covered(b, of(i), 1).sum()) for i, b in enumerate(blocks)]


def test_anchors_are_spread_evenly_over_their_owners():
    rng = random.Random(5)
    block = suffix_dedup.Block(["".join(rng.choice("abcdefgh ") for _ in range(200_000)).encode()], 200, 128)
    n = np.diff(suffix_dedup.split_parts(block.anchors, 10, ranges=True)[1])
    assert n.sum() > 1000 and n.max() < 1.5 * n.mean()


def test_the_sort_decides(monkeypatch):
    texts = edges(12)
    want = [w[1] for w in brute_repeats(texts, 200)]
    assert removed(texts) == want == removed(texts, hot=1)
    monkeypatch.setattr(suffix_dedup, "equal_groups", lambda prefix, data, at, bucket, limit: np.arange(len(at)))
    assert removed(texts) != want  # nothing else finds what only the edges share


def test_repeats_of_short_strings_and_kept_bytes(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    got = suffix_dedup.repeated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=8, k=4, kept=True, block_bytes=100).orderBy("doc_id").collect()
    for r, w in zip(got, brute_repeats(texts, 8), strict=True):
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w and hashlib.sha256(r.kept_text).hexdigest() == w[3]
    assert suffix_dedup.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts_and_many_repeated_rows(spark):
    long_ = " ".join(str(i) for i in range(400_000))  # 2.7 MB, no string twice
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("r" * 250).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(1, long_), (2, long_[-500:]), (3, "x" * 3_000_000)], "doc_id long, text string"))
    got = suffix_dedup.repeated(rows, block_bytes=1 << 20).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_removed").alias("low"), F.max("n_removed").alias("high")).collect()
    assert {(r.doc_id, r.n, r.low, r.high) for r in got} == {(None, 100_000, 250, 250), (1, 1, 500, 500), (2, 1, 500, 500), (3, 1, 3_000_000, 3_000_000)}


def test_collisions_are_verified():
    import numpy as np

    data = np.frombuffer(b"abcdabcdabce", dtype=np.uint8)
    blind = suffix_dedup.Prefix(data)
    blind.sums[:] = 0  # every hash is equal now
    group = suffix_dedup.equal_groups(blind, data, np.array([0, 4, 8]), np.zeros(3, np.uint64), 4)
    assert group[0] == group[1] != group[2]


def xxh_fingerprint(text, words, lanes):
    """Majority bits counted one by one."""
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for y in w for x in re.split(r"[\x09-\x0d]+", y) if x]
    grams = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    out = 0
    for lane in range(lanes):
        values = h if not lane else [int(mix(np.array([x], np.uint64) + np.uint64(lane))[0]) for x in h]
        for bit in range(63, -1, -1):
            out = out << 1 | (2 * sum(x >> bit & 1 for x in values) > len(values))
    return out


def components(marks, radius):
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, f) in enumerate(marks):
        for j in range(i):
            if (f ^ marks[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    name = {}
    for i, (k, _) in enumerate(marks):
        if k is not None:
            name[find(i)] = min(name.get(find(i), k), k)
    return [name.get(find(i)) for i in range(len(marks))]


@pytest.mark.parametrize("words,radius,lanes,bucket", [(4, 4, 1, 16384), (4, 4, 1, 3), (5, 18, 4, 16384)])
def test_simhash_components(spark, monkeypatch, words, radius, lanes, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    texts = sample(spark)
    df = frame(spark, texts).select("doc_id", "text").unionByName(spark.createDataFrame([(None, "Two words")], "doc_id long, text string"))
    ids = [*range(len(texts)), 0, None]
    marks = [(k, xxh_fingerprint(t, words, lanes)) for k, t in zip(ids, [*texts, texts[0], "Two words"], strict=True)]
    want = sorted((str(k), f"{f:0{16 * lanes}x}", str(c)) for (k, f), c in zip(marks, components(marks, radius), strict=True))
    got = simhash.near_duplicates(df, words=words, radius=radius, lanes=lanes).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def near_rows(spark, monkeypatch, rows, radius=4):
    """near_duplicates of rows (id, fingerprint)."""
    made = spark.createDataFrame([(k, f"{f:016x}") for k, f in rows], "doc_id long, fingerprint string")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: made)
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(made.withColumn("text", F.lit(""))).collect())


def test_rows_link_whatever_their_ids(spark, monkeypatch):
    a, m, b, x, y = 0, 0b1111, 0b1111111 << 3, 0xFFFF << 40, (0xFFFF << 40) + 7
    b = m ^ (0b111 << 10)
    for rows in (
        [(1, a), (None, m), (3, b)],  # only the row without an id links the others
        [(1, a), (None, m)],
        [(None, a), (None, m), (7, x)],
        [(1, a), (5, a), (5, x), (9, x)],  # one id in two components
        [(5, a), (5, x), (2, y)],
        [(4, a)] * 3 + [(3, m)] * 2,
    ):
        assert near_rows(spark, monkeypatch, rows) == sorted((str(k), f"{f:016x}", str(c)) for (k, f), c in zip(rows, components(rows, 4), strict=True))


def test_random_fingerprints_near_and_far(spark, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(simhash, "BUCKET", 40)
    monkeypatch.setattr(simhash, "ROW_COST", 0)  # as many bands as there may be
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(400):
        f = rng.choice(base)
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            f ^= 1 << bit
        rows.append((i, f))
    assert near_rows(spark, monkeypatch, rows) == sorted((str(k), f"{f:016x}", str(c)) for (k, f), c in zip(rows, components(rows, 4), strict=True))


@pytest.mark.parametrize("half", [None, 90])
def test_tiles_link_like_all_pairs(half):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    for spread in (1, 4, 9):  # one tight group, loose ones, and none
        bits = base[rng.integers(0, 6 if spread > 1 else 1, 200)][:, None].copy()
        for _ in range(spread):
            bits[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
        label = simhash.link_tiles(bits, half, 4, tile=16)
        root = list(range(200))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(200):
            for j in range(i):
                if (half is None or (j < half) != (i < half)) and int(bits[i, 0] ^ bits[j, 0]).bit_count() <= 4:
                    root[max(find(i), find(j))] = min(find(i), find(j))
        assert label.tolist() == [find(i) for i in range(200)]


def test_bands_are_exact_at_every_size():
    rng = np.random.default_rng(5)
    f = rng.integers(0, 1 << 63, (300, 1), dtype=np.uint64)
    g = f.copy()
    for _ in range(4):
        g[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    used = {simhash.bands_for(10**e, 4, 64) for e in range(2, 14)}
    assert len(used) > 2
    for bands in used:
        assert (simhash.band_keys(f, 4, bands) == simhash.band_keys(g, 4, bands)).any(axis=1).all()
    with pytest.raises(ValueError, match="radius"):
        simhash.bands_for(10, 30, 64)


def test_simhash_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.fingerprint(b"", 4, 1) == ("0" * 16, 0)


def test_long_chains_settle(spark):
    n = 300
    edges = spark.range(1, n).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n)}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_marks(texts, items, window=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for s in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + window]), set()).add(i)
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for g, owners in windows.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found |= owners
        out.append((len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 23, 300])
def test_marks_equal_brute_force(spark, slice_bytes):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()] + [(100, "Quick brown FOX"), (101, None), (102, " . "), (None, "null id words"), (103, "a " * 30), (100, "Quick brown FOX")]
    texts = [*sample(spark, 60), "the quick, BROWN-fox ran", "null id words", "a " * 11, items[0][1] + " x " + items[0][1], items[1][1][:-20]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, texts).drop("items")
    got = decontaminate.mark(df, bench, slice_bytes=slice_bytes)
    assert got.columns == [*df.columns, "n_words", "hit_words", "items"]
    want = brute_marks([*texts, texts[0]], items)
    assert sorted((r.doc_id, r.n_words, r.hit_words, r["items"]) for r in got.collect()) == sorted((i % len(texts), *w) for i, w in enumerate(want))
    assert decontaminate.mark(df, bench.limit(0)).filter(F.size("hit_words") > 0).count() == 0
    assert decontaminate.mark(df.limit(0), bench).count() == 0


def test_shards(spark):
    path = f"{shared_dir(spark)}/table"
    table = shards.ShardTable(spark, path, target_bytes=4096, fan_in=3)
    assert table.version() == 0 and table.runs() == []
    rows = spark.range(900).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), (F.col("id") % 9).cast("int"))).alias("text"), F.lit(None).cast("int").alias("a.b"))
    for i in range(5):
        table.append(rows.filter(F.col("id") % 5 == i))
    table.append(rows.limit(0))
    runs = table.runs()
    assert sum(r.n_rows for r in runs) == 900 and max(r.tier for r in runs) >= 1 and len(runs) < 6
    assert table.read().exceptAll(rows).count() == 0 and table.read().count() == 900
    old = table.version() - 1
    assert table.read(old).count() == 900
    first = table.read(1).count()
    assert first == 180
    table.vacuum()
    assert table.read().count() == 900
    with pytest.raises(shards.Conflict):
        table._commit(table.version() - 1, runs)
    assert table.version() == old + 1


def test_shards_keep_columns_that_come_and_go(spark):
    table = shards.ShardTable(spark, f"{shared_dir(spark)}/columns", fan_in=2)
    table.append(spark.createDataFrame([(1, "a")], "id long, text string"))
    table.append(spark.createDataFrame([(2, "b", 7)], "id long, text string, extra int"))
    table.append(spark.createDataFrame([("c",)], "text string"))
    assert max(r.tier for r in table.runs()) >= 1 and table.read().columns == ["id", "text", "extra"]
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted([(1, "a", None), (2, "b", 7), (None, "c", None)], key=str)
    at = table.version()
    with pytest.raises(ValueError, match="column id"):
        table.append(spark.createDataFrame([("x", "y")], "id string, text string"))
    assert table.version() == at


def test_shards_have_the_size_that_was_asked_for(spark):
    table = shards.ShardTable(spark, f"{shared_dir(spark)}/sizes", target_bytes=100_000, fan_in=2)
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    for i in range(2):
        table.append(rows.filter(F.col("id") % 2 == i).coalesce(1))
    (run,) = table.runs()
    sizes = [s.getLen() for s in table._fs.listStatus(table._at("data", run.run)) if s.getPath().getName().endswith(".parquet")]
    assert len(sizes) >= run.bytes // 100_000 and max(sizes) < 200_000 and table.read().count() == 20_000


def test_vacuum_removes_what_dead_writers_left(spark):
    table = shards.ShardTable(spark, f"{shared_dir(spark)}/orphans", fan_in=9)
    table.append(spark.range(3).select("id"))
    table._write(spark.range(4).select("id"), 0)  # died before its commit
    spark.range(1).write.parquet(f"{table.path}/manifest/draft-dead")
    table.vacuum()
    assert len(table._fs.listStatus(table._at("data"))) == 2  # it may still be at work
    table.vacuum(orphan_seconds=0)
    assert len(table._fs.listStatus(table._at("data"))) == 1 and len(table._fs.listStatus(table._at("manifest"))) == 1 and table.read().count() == 3


def test_shard_writers_retry(spark):
    table = shards.ShardTable(spark, f"{shared_dir(spark)}/raced", fan_in=50)
    other = shards.ShardTable(spark, table.path, fan_in=50)
    rows, once = spark.range(3).select("id"), []
    commit = table._commit

    def raced(version, runs):
        if not once:
            once.append(1)
            other.append(rows)
        return commit(version, runs)

    table._commit = raced
    table.append(rows)
    assert table.version() == 2 and table.read().count() == 6


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"items": F.lit("x"), "a.b": F.lit(None).cast("int"), "__row": F.lit(1), "__text": F.lit("y"), "__found": F.lit(2), "failed": F.lit(True)})
    near = docs.filter("doc_id = 3").withColumns({"doc_id": F.lit(10_000).cast("long"), "text": F.concat("text", F.lit(" more words"))})
    docs = docs.unionByName(near).unionByName(docs.filter("doc_id = 1")).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    columns, counts = docs.columns, []
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["quality rules"](spark, docs, sf)
    counts.append(clean.count())
    assert clean.columns == columns and clean.filter("text is null").count() == 0
    single = stage["near duplicates"](spark, clean, sf)
    ids = [r.doc_id for r in single.select("doc_id").collect()]
    assert single.columns == columns and len(ids) == len(set(ids)) and 3 in ids and 10_000 not in ids
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = stage["decontamination"](spark, single, sf)
    rows = single.select("doc_id", "text").collect()
    hits = brute_marks([r.text for r in rows], bench)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r, h in zip(rows, hits, strict=True) if not h[1]} and kept.columns == columns
    hidden = stage["pseudonyms"](spark, kept, sf)
    assert hidden.columns == columns and hidden.count() == kept.count()
    assert stage["byte pairs"](spark, hidden, sf).count() == kept.count()
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), sf).count() == 0, name
