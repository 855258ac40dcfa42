"""The registered queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_topk, jaccard_join, line_dedup, packing, quality, sharding, substring_dedup, token_counts, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{k:05d}" for k in range(sharding.SHARDS)]
    return sharding.place(_read(spark, sf_dir, "documents").select("doc_id"), shards)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _read(spark, sf_dir, "documents"), lambda i: F.crc32(i.cast("string")) % 3 == 1
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), allowed=lambda i: ~held_out(i))
    return toxicity.score_documents(docs, model).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _read(spark, sf_dir, "documents"), lambda i: F.crc32(i.cast("string")) % 4 == 2
    model = quality.train(docs, _read(spark, sf_dir, "labels"), allowed=lambda i: ~held_out(i))
    return quality.score_documents(docs, model).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_texts(_read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_read(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda kept: F.sha2(kept, 256)
    return substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents"), kept_as=digest).withColumnRenamed("kept", "kept_sha256")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontamination.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontamination.leak_digest(leaks)


QUERIES = {f.__name__: f for f in (op1_packing, op2_sharding, op3_toxicity, op4_quality, op5_token_counts, op6_jaccard_join, op7_line_dedup, op8_exact_topk, op9_substring_dedup, op10_decontamination)}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "translate(trim(x, {ws}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".replace("{ws}", _WS)

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_SPLIT = r"'[^\x20\x09-\x0D]+'"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op6_jaccard_join": f"""
        WITH RECURSIVE t AS (SELECT coalesce(text, '') AS t, min(doc_id) AS tid, count(*) AS n_copies FROM documents GROUP BY 1),
        w AS (SELECT tid, regexp_extract_all({_LOWER.replace("coalesce(text, '')", "t")}, {_BLANK_SPLIT}) AS w FROM t),
        g AS (SELECT DISTINCT tid, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT tid, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
        s AS (SELECT tid, count(*) AS s FROM g GROUP BY 1),
        p AS (SELECT a.tid AS a, b.tid AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.tid < b.tid GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN s x ON x.tid = a JOIN s y ON y.tid = b WHERE n >= 0.8 * (x.s + y.s - n) - 1e-9),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        c AS (SELECT tid, tid AS r FROM t UNION SELECT e.b, c.r FROM c JOIN e ON c.tid = e.a),
        k AS (SELECT tid, min(r) AS class_id FROM c GROUP BY 1),
        n AS (SELECT a AS tid, count(*) AS n_links FROM e GROUP BY 1)
        SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies
        FROM documents JOIN t ON t.t = coalesce(documents.text, '') JOIN k USING (tid) LEFT JOIN n USING (tid)
    """,
    "op9_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK_SPLIT}) AS w FROM documents),
        win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
        hit AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win WHERE h IN (SELECT h FROM dup)),
        x AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
        k AS (SELECT x.r, count(hit.p) AS n_removed, string_agg(x, ' ' ORDER BY x.p) FILTER (hit.p IS NULL) AS kept FROM x LEFT JOIN hit ON x.r = hit.r AND x.p = hit.p GROUP BY x.r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
    """,
    "op10_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        bw AS (SELECT item, least(10, len(w)) AS k, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
        bk AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bw),
        dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
               FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM bk) ON len(w) >= k)),
        h AS (SELECT DISTINCT r, i, dw.k, item FROM dw JOIN bk ON dw.k = bk.k AND dw.s = bk.s),
        n AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
        q AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (r) LEFT JOIN q USING (r)
    """,
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
    "op7_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, i, lines[i] AS x FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
        k AS (SELECT r, i, x, {_FOLD} AS k FROM l),
        f AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
        m AS (SELECT k.*, f.k IS NOT NULL AS gone FROM k LEFT JOIN f ON k.k = f.k)
        SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m JOIN d USING (r) GROUP BY d.r, d.doc_id
    """,
}
