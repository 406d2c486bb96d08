"""The registered queries: columns and types, a row a document, and what contracts fix."""

import hashlib
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from maskframe.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pseudonyms": "doc_id bigint, text string, n_replaced bigint",
    "op2_ngram_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_token_counts": "context_limit bigint, n_docs bigint, n_docs_over bigint, tokens_over bigint, truncated_total bigint, lost_tokens bigint, total_tokens bigint, quantile double",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_shards": "doc_id bigint, arrival int, n_bytes bigint, text_sha256 string",
    "op7_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, failed bigint",
    "op11_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket_place bigint",
    "op12_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op13_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
}
#: Queries with other rows than one a document.
OTHER_ROWS = {"op3_token_counts", "op11_packing", "op12_hard_negatives", "op13_conversation_repair"}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, docs, name):
    df = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) == COLUMNS[name]
    rows = df.collect()
    if name not in OTHER_ROWS:
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if name in ("op2_ngram_lm", "op7_quality_classifier"):
        mod, rest = (5, 1) if name == "op2_ngram_lm" else (4, 2)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)
    if name == "op8_bpe":
        lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        lib.no_padding()
        lib.no_truncation()
        for r in rows:
            ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    if name == "op1_pseudonyms":
        assert all((r.n_replaced > 0) == (r.text != docs[r.doc_id]) for r in rows)
        assert not any(m in r.text for r in rows for m in re.findall(r"[\w.]+@[a-z0-9]+\.example\.com", docs[r.doc_id]) if len(m.split("@")[0]) > 3)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "embeddings"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        got = con.execute(queries.ORACLE_SQL[name])
        names = sorted(d[0] for d in got.description)
        assert names == sorted(df.columns)
        at = [[d[0] for d in got.description].index(c) for c in names]
        assert sorted(repr([row[i] for i in at]) for row in got.fetchall()) == sorted(repr([r[c] for c in names]) for r in rows)
