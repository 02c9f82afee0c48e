"""The registered queries over their whole small tables: shapes, digests, and SQL where it exists."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import check_queries
from framewise.llm.queries import QUERIES, SQL, vocabulary

COLUMNS = {
    "op1_": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op2_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_": ["doc_id", "first_word", "until_word", "source_id", "kept"],
    "op4_": ["doc_id", "held_out", "score", "predicted"],
    "op5_": ["doc_id", "fingerprint", "component_id"],
    "op6_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_": ["page_id", "host", "path", "rule", "verdict"],
    "op8_": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op9_": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op10_": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    return {prefix: next(f for n, f in QUERIES.items() if n.startswith(prefix))(spark, sf_dir).toPandas() for prefix in COLUMNS}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_columns(results):
    for prefix, columns in COLUMNS.items():
        assert list(results[prefix].columns[: len(columns)]) == columns


def test_one_row_for_each_document(results, texts):
    for prefix in ("op1_", "op2_", "op4_", "op5_", "op6_", "op8_", "op10_"):
        assert sorted(results[prefix].doc_id) == sorted(texts)


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, sf_dir, name):
    ok, text, _ = check_queries.compare(spark, check_queries.duck(sf_dir), name, QUERIES[name], SQL[name], sf_dir)
    assert ok, text


def test_digests(results, texts):
    words = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for r in results["op2_"].itertuples():
        ids = words.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(words.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    pieces = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {i: pieces.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    for r in results["op9_"].itertuples():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    assert {r.doc_id: r.n_tokens + 1 for r in results["op10_"].itertuples()} == {i: len(v) for i, v in ids.items()}


def test_scores(results):
    r = results["op4_"]
    assert ((r.score >= 0) & (r.score <= 1)).all() and (r.predicted == (r.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(r.doc_id, r.held_out))
