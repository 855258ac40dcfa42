"""Queries on small odd tables against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sievecraft.plans import catalogue


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"CREATE TABLE {t} AS {sql}")
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    df = catalogue.QUERIES[name](spark, str(folder))
    got = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in got.description]
    return sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))), sorted(map(str, got.fetchall()))


def test_scan_filter_takes_urls_that_end_in_a_slash_by_size(spark, tmp_path):
    pages = "SELECT * FROM (VALUES (1, 'http://a/b/', repeat('x', 128)), (2, 'http://a/b/', repeat('x', 127)), (3, 'http://a/c.HTML', ''), (4, 'http://a/', ''), (5, 'a.syx', NULL), (6, NULL, repeat('x', 163)), (7, 'b' || chr(10) || '.syx', 'x')) t(page_id, url, html)"
    got, want = both(spark, tmp_path, "scan_filter_candidates", pages=pages)
    assert got == want


def test_display_sources_ties_and_nulls(spark, tmp_path):
    supplier = "SELECT * FROM (VALUES (1, 'b'), (2, 'a'), (3, NULL), (4, 'c/d')) t(s_suppkey, s_name)"
    lineitem = "SELECT * FROM (VALUES (1, 1, 5, 1), (1, 2, 5, 1), (2, 3, 1, 1), (2, 2, 2, 1), (3, 4, 1, 1), (4, 1, NULL, 1), (4, 2, 7, 1), (5, 3, 1, 1), (5, 3, 2, 1)) t(l_partkey, l_suppkey, l_orderkey, l_linenumber)"
    got, want = both(spark, tmp_path, "display_sources", supplier=supplier, lineitem=lineitem)
    assert got == want


def test_display_sources_of_suppliers_that_share_a_key(spark, tmp_path):
    supplier = "SELECT k AS s_suppkey, CASE WHEN k = 3 AND i = 2 THEN NULL ELSE 's' || (7 * k + 5 * i) % 11 END AS s_name FROM range(6) a(k), range(3) b(i) ORDER BY i, k"
    lineitem = "SELECT r % 20 AS l_partkey, r * 7 % 8 AS l_suppkey, r % 9 AS l_orderkey, r % 4 AS l_linenumber FROM range(200) t(r) ORDER BY r"
    got, want = both(spark, tmp_path, "display_sources", supplier=supplier, lineitem=lineitem)
    assert got == want


def test_interpolate_neighbours_blends_eight_of_the_voted_kind(spark, small):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{small}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x, labels = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64), [r[2] for r in rows]
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    want = {}
    for t in range(0, len(ids), 9):
        order = sorted((d[t, j], ids[j], j) for j in range(len(ids)) if j != t)
        votes = dict.fromkeys(labels, 0.0)
        for dist, _, j in order[:24]:
            votes[labels[j]] += 1 / (dist * dist + 1e-6)
        kind = min(votes, key=lambda c: (-round(votes[c], 9), c))
        same = [o for o in order if labels[o[2]] == kind][:8]
        w = np.exp([-1.8 * dist / same[-1][0] for dist, _, _ in same])
        want[ids[t]] = kind, (np.floor((x[[j for _, _, j in same]] + 1) * 50) * w[:, None]).sum(0) / w.sum()
    got = {t: (set(), np.full(64, np.nan)) for t in want}
    for r in catalogue.QUERIES["interpolate_neighbours"](spark, small).where(F.col("target").isin(list(want))).collect():
        got[r.target][0].add(r.label)
        got[r.target][1][r.pos] = r.value
    for t, (kind, mean) in want.items():
        assert got[t][0] == {kind} and np.abs(got[t][1] - mean).max() <= 0.5 + 1e-6
