"""The registered queries over the smallest tables: brute force, SQL, exact round trips or held-out accuracy."""

import collections
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from fixtures import sorted_rows
from test_operators import brute_leaks, brute_lines, brute_links, brute_windows, sha
from tokenizers import Tokenizer

from sievecraft.llm import queries, sharding


@pytest.fixture(scope="module")
def rows(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


def test_op1(spark, small, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    got = queries.op1_packing(spark, small).collect()
    at, total = collections.Counter(), sum(map(len, ids.values()))
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
    assert sum(at.values()) == total
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert len(ends) == -(-total // 2048) and max(ends.values()) <= 2048


def test_op2(spark, small, rows):
    got = queries.op2_sharding(spark, small)
    assert got.count() == len(rows) and got.select("shard").distinct().count() > 30
    table = sharding.lookup_table([f"shard-{k:05d}" for k in range(64)])
    assert all(table[r.slot] == r.shard for r in got.collect())


@pytest.mark.parametrize("name,label,held", [("op3_toxicity", "toxic", lambda c: c % 3 == 1), ("op4_quality", "quality", lambda c: c % 4 == 2)])
def test_op3_op4(spark, small, name, label, held):
    folder = small.replace("sf0.001", "sf0.1")
    got = queries.QUERIES[name](spark, folder)
    assert set(got.columns) == {"doc_id", "held_out", "score", "predicted"}
    got = got.collect()
    assert all(r.held_out == held(zlib.crc32(str(r.doc_id).encode())) and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    pairs = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in pairs]) > 0.97
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_op5(spark, small, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert sorted_rows(queries.op5_token_counts(spark, small), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_op6(spark, small, rows):
    assert sorted_rows(queries.op6_jaccard_join(spark, small), "doc_id", "class_id", "n_links", "n_copies") == brute_links(rows)


def test_op7(spark, small, rows):
    want = sorted(((i, n, d, sha(k)) for i, n, d, k in brute_lines(rows, 10)), key=repr)
    assert sorted_rows(queries.op7_line_dedup(spark, small), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_op9(spark, small, rows):
    want = sorted(((i, n, d, sha(k)) for i, n, d, k in brute_windows(rows, 35)), key=repr)
    assert sorted_rows(queries.op9_substring_dedup(spark, small), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_op10(spark, small, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = brute_leaks(rows, items, 10)
    assert any(w[-1] for w in want)
    assert sorted_rows(queries.op10_decontamination(spark, small), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    df = queries.QUERIES[name](spark, small)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(map(str, (tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()))) == sorted(str(tuple(r)) for r in df.collect())
