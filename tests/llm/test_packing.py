"""Packing: ids by the library, lengths by binary digits, numbers without gaps."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from maskframe.llm import packing, queries

PATHS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATHS[1])
    out.no_padding()
    out.no_truncation()
    return lambda text: [*out.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, ids_of, longest=1024):
    """Every document's pieces give its ids in order; sequences are powers of two, numbered densely, longest first."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = ids_of(text)
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        assert [r.length for r in pieces] == packing.binary_lengths(len(ids), longest)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert all(r.doc_tokens == len(ids) and r.offset == 0 for r in pieces)
        yield doc, ids, pieces
    numbers = sorted((r.sequence_id, r.length) for r in rows)
    assert [n for n, _ in numbers] == list(range(len(rows)))
    assert [length for _, length in numbers] == sorted((length for _, length in numbers), reverse=True)


def test_binary_lengths():
    assert packing.binary_lengths(1) == [1]
    assert packing.binary_lengths(1024) == [1024]
    assert packing.binary_lengths(2048 + 5) == [1024, 1024, 4, 1]
    assert all(sum(packing.binary_lengths(n, 8)) == n and all(x & (x - 1) == 0 and x <= 8 for x in packing.binary_lengths(n, 8)) for n in range(1, 200))
    with pytest.raises(ValueError):
        packing.decompose(None, *PATHS, longest=1000)


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_packing"](spark, SF).collect()
    for _, ids, pieces in check(rows, texts, library):
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in pieces)


def test_edges(spark, library):
    texts = {1: None, 2: "", 3: "<|endoftext|>ab<|endoftext|>", 4: "word " * 30_000, 5: " " * 60_000 + "x", 6: "\U0001f600é́ a"}
    df = spark.createDataFrame([(k, v, "s", 1) for k, v in texts.items()], "doc_id long, text string, start string, length int").repartition(3)
    rows = packing.pack(df, *PATHS, longest=16).collect()
    for _, ids, pieces in check(rows, texts, library, 16):
        assert [x for r in pieces for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
    kept = packing.pack(df, *PATHS, keep=["start", "doc_id", "text"])
    assert kept.columns == ["start", "doc_id", "text", "start_", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket_place"]
    assert {(r.start, r.doc_id, r.text) for r in kept.collect()} == {("s", k, v) for k, v in texts.items()}
    assert packing.pack(df.filter("doc_id < 0"), *PATHS).collect() == []
    twice = packing.pack(df.unionAll(df), *PATHS).collect()
    assert sorted(r.sequence_id for r in twice) == list(range(len(twice)))
    assert {r.doc_id for r in twice if r.start == 0} == set(texts)


def test_batches_and_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "tok " * i) for i in range(40)], "doc_id long, text string")
    packed = packing.pack(df, *PATHS)
    rows = packing.batches(packed, 32).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.length, r.batch), []).append(r)
    assert all(sum(r.length for r in g) <= 32 or len(g) == 1 for g in groups.values())
    packing.write(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.select("length").distinct().count() == len({r.length for r in rows})
