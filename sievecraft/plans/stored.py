"""Queries of sources, stored tables, sessions and small checks whose outcome SQL can state."""

from __future__ import annotations

import io
import uuid
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..audio import routes, synth
from ..functions import codecs
from ..functions.storage import shared_dir
from ..operators import neighbours, sequence, vectors
from ..sources import banks, files, tables
from .records import _PARAMS, _params
from .registry import Registry, read
from .vectors import _D2, _E, DIM, _rows

registry = Registry()
query = registry.query


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sievecraft/stored-{uuid.uuid4().hex}"


# --- files and archives ----------------------------------------------------------------------

@query("SELECT source, CAST(sum(strlen(replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ')) + 1) AS BIGINT) AS bytes FROM documents WHERE source IS NOT NULL GROUP BY 1")
def file_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Files in folders by source, found again by a recursive walk."""
    path = _folder(spark)
    line = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    read(spark, sf, "documents").where("source IS NOT NULL").select(line.alias("value"), "source").write.partitionBy("source").text(path)
    found = files.scan_files(spark, path, inside_folder=False).where(~F.contains("path", F.lit("_SUCCESS")))
    return found.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(F.sum("length").alias("bytes"))


def _archives(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: an archive for each document, of a candidate entry with the text, one of another kind, and a folder; every tenth archive is broken."""

    @F.pandas_udf("binary")
    def build(doc_id: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for i, t in zip(doc_id, text):
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED) as z:
                z.writestr(zipfile.ZipInfo("folder/", (1990, 1, 1, 0, 0, 0)), b"")
                z.writestr(zipfile.ZipInfo("folder/bank.SYX", (1980 + i % 40, 2, 3, 4, 5, 6)), (t or "").encode())
                z.writestr(zipfile.ZipInfo("notes.txt", (1990, 1, 1, 0, 0, 0)), b"no candidate")
            out.append(b"broken" + raw.getvalue()[:40] if i % 10 == 9 else raw.getvalue())
        return pd.Series(out)

    return read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), build("doc_id", "text").alias("content"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS archive, CASE WHEN doc_id % 10 <> 9 THEN 'folder/bank.SYX' END AS entry, CASE WHEN doc_id % 10 <> 9 THEN 1980 + CAST(doc_id % 40 AS INTEGER) END AS year,
    CASE WHEN doc_id % 10 <> 9 THEN md5(text) END AS digest, doc_id % 10 = 9 AS failed FROM documents WHERE doc_id % 10 = 9 OR strlen(coalesce(text, '')) > 0""")
def zip_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = files.open_zips(_archives(spark, sf))
    return found.select("archive", "entry", F.year("at").alias("year"), F.md5("content").alias("digest"), F.col("error").isNotNull().alias("failed"))


# --- stored tables ---------------------------------------------------------------------------

@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS v FROM orders UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 5 = 0""")
def table_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table after an upsert of known and unknown keys."""
    t, o = tables.Table(spark, f"{_folder(spark)}/t", "id long, v string"), read(spark, sf, "orders")
    t.replace(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("v")))
    t.put(o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("v")).unionByName(o.where("o_orderkey % 5 = 0").select((-F.col("o_orderkey")).alias("id"), F.lit("added").alias("v"))), "id")
    return t.read()


@query("SELECT count(*) AS before, count(*) FILTER (c_custkey = 7) AS seventh, CAST(0 AS BIGINT) AS after FROM customer")
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of a stored table, a point lookup, and what is left after it was cleared."""
    t = tables.Table(spark, f"{_folder(spark)}/t", "id long, v string")
    t.replace(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v")))
    before, seventh = t.count(), t.get("id", 7).count()
    t.clear()
    return spark.createDataFrame([(before, seventh, t.count())], "before long, seventh long, after long")


@query("SELECT * FROM (VALUES ('kept', '[1, 2]'), ('twice', '\"second\"')) AS t(name, value)")
def settings_last_write(spark: SparkSession, sf: str) -> DataFrame:
    s = tables.Settings(spark, f"{_folder(spark)}/s")
    for name, value in (("kept", [1, 2]), ("twice", "first"), ("gone", 3), ("twice", "second")):
        s.set(name, value)
    s.delete("gone")
    return s.read().where(F.col("name").isin(list(s.all()))).groupBy("name").agg(F.max_by("value", "seq").alias("value"))


@query("""SELECT 'voices' AS part, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM documents UNION ALL SELECT 'links', count(*), CAST(sum(doc_id + 1) AS BIGINT) FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT 'coords', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents UNION ALL SELECT 'features', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents""")
def session_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """What a session holds after it was written and read; features are in it as every voice has them."""
    path, ids = _folder(spark), read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    features = ids.select(F.col("id").alias("voice_id"), F.lit(tables.ANALYSIS_VERSION).alias("analysis_version"), F.array_repeat(F.lit(0.5), tables.DIM).alias("vector"))
    tables.write_session(path, ids, features, ids.where("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), ids.select("id", F.lit(0.0).alias("x")))
    got = tables.read_session(spark, path, {"voices": "id long", "features": "voice_id long", "links": "b long", "coords": "id long"})
    out = None
    for name, df in got.items():
        row = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum(df.columns[0]).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT count(*) AS n, true AS same, false AS changed FROM orders")
def stale_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """A digest that the order of rows does not change, and a changed row does."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    one, other = tables.fingerprint(o, *o.columns).first(), tables.fingerprint(o.repartition(5).sortWithinPartitions(F.desc("o_totalprice")), *o.columns).first()
    moved = tables.fingerprint(o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, 0.0).otherwise(F.col("o_totalprice"))), *o.columns).first()
    return spark.createDataFrame([(one.n, one == other, one == moved)], "n long, same boolean, changed boolean")


@query("SELECT CAST(bank AS INTEGER) AS bank, CASE WHEN bank % 2 = 1 THEN 'checksum' ELSE '' END AS faults FROM (SELECT DISTINCT (row_number() OVER (ORDER BY p_partkey) - 1) // 32 AS bank FROM part)")
def bank_verify(spark: SparkSession, sf: str) -> DataFrame:
    """All parts' banks, every other with a bit of its data turned, and the faults found."""
    r = _params(spark, sf).select("id", codecs.pack(F.col("params")).alias("packed"))

    @F.pandas_udf("string")
    def faults(bank: pd.Series, content: pd.Series) -> pd.Series:
        turned = [bytes([*c[:100], c[100] ^ 1, *c[101:]]) if b % 2 else bytes(c) for b, c in zip(bank, content)]
        return pd.Series([",".join(banks.verify_bank(c)) for c in turned])

    return banks.to_banks(banks.number(r, "id"), bytes(codecs.PACKED)).select("bank", faults("bank", "content").alias("faults"))


# --- records ---------------------------------------------------------------------------------

_HASH = """list_reduce(list_prepend({seed}::HUGEINT, {values}), lambda h, x: {step} % 4294967296)"""


@query(f"""WITH {_PARAMS}, c AS (SELECT id, list(v::HUGEINT ORDER BY i) AS v, list((v + i - 1)::HUGEINT ORDER BY i) AS w FROM p WHERE i <= 145 GROUP BY id)
    SELECT id, lower(to_base(CAST({_HASH.format(seed=0x811C9DC5, values="v", step="(CAST(xor(CAST(h AS UBIGINT), CAST(x AS UBIGINT)) AS HUGEINT) * 16777619)")} AS BIGINT), 36)
        || to_base(CAST({_HASH.format(seed=0x01000193, values="w", step="(((h + x) % 4294967296) * 2246822507)")} AS BIGINT), 36)) AS name FROM c""")
def content_names(spark: SparkSession, sf: str) -> DataFrame:
    """Short names of all parts' records."""
    return _params(spark, sf).select("id", codecs.content_hash(F.col("params")).alias("name"))


# fixed values: how many carriers each of the 32 algorithms has
_CARRIERS = [2, 2, 2, 2, 3, 3, 2, 2, 2, 2, 2, 2, 2, 2, 2, 1, 1, 1, 3, 3, 4, 4, 4, 5, 5, 3, 3, 3, 4, 4, 5, 6]


@query(f"SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS algorithm, CAST(unnest({_CARRIERS}) AS INTEGER) AS carriers, CAST(6 AS INTEGER) AS reached")
def algorithm_carriers(spark: SparkSession, sf: str) -> DataFrame:
    """Carriers of every algorithm, and operators that are heard directly or through others."""
    rows = []
    for a in range(32):
        heard, links = set(routes.carriers(a)), routes.links(a)
        while new := {m for m, o in links if o in heard} - heard:
            heard |= new
        rows.append((a, len(routes.carriers(a)), len(heard)))
    return spark.createDataFrame(rows, "algorithm int, carriers int, reached int")


@query("SELECT p_partkey AS id, CAST(44 + 2 * (64 + p_partkey % 200) AS BIGINT) AS size, 'RIFF' AS head, CAST(44100 AS INTEGER) AS rate FROM part")
def wav_files(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf("binary")
    def encode(n: pd.Series) -> pd.Series:
        return n.map(lambda k: synth.wav(np.sin(np.arange(64 + k % 200) / 7)))

    made = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), encode("p_partkey").alias("w"))
    byte = lambda k: F.conv(F.hex(F.substring(F.col("w"), k, 1)), 16, 10).cast("int")
    rate = byte(25) + byte(26) * 256 + byte(27) * 65536
    return made.select("id", F.octet_length("w").cast("long").alias("size"), F.decode(F.substring("w", 1, 4), "utf-8").alias("head"), rate.alias("rate"))


@query("SELECT p_partkey AS id, true AS finite, p_partkey % 4 = 0 AS silent FROM part")
def rendered_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all parts as sound; those whose levels are all zero are silent, those with an open carrier are heard."""
    made = _params(spark, sf)
    level = F.when(F.col("id") % 4 == 0, 0).otherwise(99)
    # operators with a plain envelope and the level above, a ratio of one, no key scaling
    one = F.array(*[F.lit(x) for x in (99, 99, 99, 99, 99, 99, 99, 0, 0, 0, 0, 0, 0, 0, 0, 0)], level, F.lit(0), F.lit(1), F.lit(0), F.lit(7))
    params = F.concat(F.flatten(F.array_repeat(one, 6)), F.slice(F.col("params"), 127, 29))
    plain = F.transform(params, lambda v, i: F.when((i >= 126) & (i < 130), 99).when((i >= 130) & (i < 134), 50).when(i == 144, 24).otherwise(v))
    sound = synth.render_column(made.select("id", plain.alias("params")), hold=0.03, tail=0.01)
    loud = F.aggregate("samples", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x).cast("double")))
    return sound.select("id", F.forall("samples", lambda x: ~F.isnan(x) & (F.abs(x) < 10)).alias("finite"), (loud < 1e-6).alias("silent"))


# --- vectors and orders ----------------------------------------------------------------------

@query("SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, CASE WHEN a = b THEN 1.0e0 ELSE 0.0e0 END AS cov FROM range(0, 64) x(a), range(0, 64) y(b) WHERE a <= b")
def whitened_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """Whitened without a ridge or a bound, vectors have the unit matrix as their covariance."""
    rows = _rows(spark, sf)
    white = vectors.whitener(vectors.collect_moments(rows, DIM)[0], ridge=0.0, gain=1e9).apply(rows, into="w").select("id", F.col("w").alias("v"))
    return vectors.covariance(white, DIM).select("i", "j", (F.round("cov", 2) + 0.0).alias("cov"))


@query("SELECT count(*) AS n, 0.0e0 AS together, true AS falling FROM embeddings")
def principal_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Principal components do not vary together, and the first varies most."""
    rows = _rows(spark, sf)
    p = vectors.pca(vectors.collect_moments(rows, DIM)[0]).apply(rows).select(F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    return p.agg(F.count(F.lit(1)).alias("n"), (F.round(F.covar_pop("x", "y"), 6) + 0.0).alias("together"), (F.var_pop("x") >= F.var_pop("y")).alias("falling"))


@query("SELECT vec_id AS i, round(log2(12), 3) AS total, 1.0e0 AS most FROM embeddings")
def membership_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Fuzzy memberships of each row add up to log2 of its neighbours; the nearest has 1."""
    w = neighbours.memberships(neighbours.knn(_rows(spark, sf), 12))
    return w.groupBy("i").agg(F.round(F.sum("w"), 3).alias("total"), F.round(F.max("w"), 6).alias("most"))


_CENTRES = [[round(((k * 7 + i * 3) % 11 - 5) / 20, 2) for i in range(64)] for k in range(4)]


@query(f"WITH {_E}, c AS (SELECT unnest([{', '.join(str(c) + '::DOUBLE[]' for c in _CENTRES)}]) AS c) SELECT round(sum(d), 6) AS inertia FROM (SELECT id, min({_D2.format(a='v', b='c')}) AS d FROM e, c GROUP BY id)")
def centroid_inertia(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.inertia(_rows(spark, sf), list(enumerate(_CENTRES))).select(F.round("inertia", 6).alias("inertia"))


@query("SELECT count(*) AS n, CAST(count(*) - 1 AS BIGINT) AS last, count(*) AS places, count(*) AS ids FROM embeddings")
def coverage_places(spark: SparkSession, sf: str) -> DataFrame:
    """A coverage order gives every row one place of its own."""
    got = sequence.coverage_order(_rows(spark, sf).select(F.lit(0).alias("plot"), "id", F.slice("v", 1, 2).alias("v")))
    first = got.agg(F.min("position").alias("p")).first().p
    return got.agg(F.count(F.lit(1)).alias("n"), (F.max("position") - first).cast("long").alias("last"), F.count_distinct("position").alias("places"), F.count_distinct("id").alias("ids"))
