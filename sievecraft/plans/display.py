"""Queries of what is shown: cells, colours, zones, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import display, families, search, sorting
from .registry import Registry, read

registry = Registry()
query = registry.query


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '·' ELSE repeat('★', CAST(p_partkey % 6 AS INTEGER)) END AS stars,
    repeat('★', CAST(least(greatest(floor(p_size / 9.0e0 + 0.5), 1), 5) AS INTEGER)) AS guess, CAST(CAST(floor(pow(10.0, (p_size - 40) / 20.0e0) * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ' ms' AS attack FROM part""")
def display_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    size = F.col("p_size")
    return p.select("p_partkey", display.stars(F.col("p_partkey") % 6).alias("stars"), display.guessed_stars(size / 9.0).alias("guess"), display.milliseconds((size - 40) / 20.0).alias("attack"))


@query("""WITH s AS (SELECT l_partkey AS id, s_name || '.syx' AS f, l_orderkey AS o, l_linenumber AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT id, CASE WHEN count(*) > 1 THEN arg_min(f, (o, n)) || ' +' || CAST(count(*) - 1 AS VARCHAR) ELSE min(f) END AS came FROM s GROUP BY id""")
def display_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The first source by order and line; of lines that tie, the one stored first, and of suppliers that share its key, the one stored last, as DuckDB's join has them."""
    stored = F.struct("_metadata.file_path", "_metadata.row_index")
    lines = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), stored.alias("stored"))
    named = read(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(".syx")).alias("file"), stored.alias("stored"))
    last = F.max_by(F.struct("file"), F.when(F.col("file").isNotNull(), F.col("stored")))
    suppliers = named.groupBy("s_suppkey").agg(last["file"].alias("file"), F.count(F.lit(1)).alias("sharing"))
    s = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    at = F.struct(F.isnull("o"), "o", F.isnull("n"), "n", "stored")  # lines without a number come last
    first = F.min_by(F.struct("file"), F.when(F.col("file").isNotNull(), at))
    one = s.groupBy(F.col("l_partkey").alias("id")).agg(first["file"].alias("file"), F.sum("sharing").alias("n"))
    return one.select("id", display.first_of(F.col("file"), F.col("n")).alias("came"))


@query("""WITH h AS (SELECT p_partkey, radians((CAST(p_partkey AS DOUBLE) * 137.508e0) % 360) AS h FROM part), l AS (SELECT p_partkey, 0.14e0 * cos(h) AS a, 0.14e0 * sin(h) AS b FROM h),
    c AS (SELECT p_partkey, pow(0.72e0 + 0.3963377774e0 * a + 0.2158037573e0 * b, 3) AS l, pow(0.72e0 - 0.1055613458e0 * a - 0.0638541728e0 * b, 3) AS m, pow(0.72e0 - 0.0894841775e0 * a - 1.291485548e0 * b, 3) AS s FROM l),
    r AS (SELECT p_partkey, unnest([4.0767416621e0 * l - 3.3077115913e0 * m + 0.2309699292e0 * s, -1.2684380046e0 * l + 2.6097574011e0 * m - 0.3413193965e0 * s, -0.0041960863e0 * l - 0.7034186147e0 * m + 1.707614701e0 * s]) AS x, unnest([1, 2, 3]) AS i FROM c),
    g AS (SELECT p_partkey, i, least(greatest(floor((CASE WHEN x <= 0.0031308e0 THEN 12.92e0 * x ELSE 1.055e0 * pow(greatest(x, 0.0), 1 / 2.4e0) - 0.055e0 END) * 255 + 0.5), 0), 255) AS v FROM r)
    SELECT p_partkey, CAST(sum(v * CASE i WHEN 1 THEN 65536 WHEN 2 THEN 256 ELSE 1 END) AS BIGINT) AS rgb FROM g GROUP BY 1""")
def colour_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rgb = display.oklch(F.lit(0.72), F.lit(0.14), display.cluster_hue(F.col("p_partkey")))
    return read(spark, sf, "part").select("p_partkey", rgb.alias("c")).select("p_partkey", (F.col("c")[0] * 65536 + F.col("c")[1] * 256 + F.col("c")[2]).cast("long").alias("rgb"))


@query("SELECT event_id, CASE WHEN value / 200.0e0 <= 0.16e0 + 1e-9 THEN 'merged' WHEN value / 200.0e0 <= 0.3e0 + 1e-9 THEN 'family' ELSE 'apart' END AS zone, CASE WHEN value / 100.0e0 > 0.25e0 THEN 'good' WHEN value / 100.0e0 > 0.08e0 THEN 'weak' ELSE 'none' END AS verdict FROM events")
def zones_and_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return read(spark, sf, "events").select("event_id", families.sweep_zone(v / 200.0, 0.16, 0.3).alias("zone"), display.verdict(v / 100.0).alias("verdict"))


@query("SELECT quality AS rating, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def rating_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return display.rating_histogram(read(spark, sf, "labels").withColumnRenamed("quality", "rating"))


@query("SELECT max(quality) AS rating, count(*) FILTER (quality = (SELECT max(quality) FROM labels)) AS n FROM labels")
def rating_top_band(spark: SparkSession, sf: str) -> DataFrame:
    return display.top_band(read(spark, sf, "labels").withColumnRenamed("quality", "rating"))


@query("SELECT count(*) AS total, count(quality) AS rated, count(*) FILTER (d.doc_id % 12 >= 8) AS settled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def progress_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return display.progress(d.select(F.col("quality").alias("rating"), (F.col("doc_id") % 12).alias("games")))


@query("SELECT p_partkey FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE contains(lower(s_name), lower('Supplier#000000003')) OR contains(lower(s_name), '3')) ON p_partkey = l_partkey")
def drill_through(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a source: its key as a phrase, searched in all scopes."""
    s = read(spark, sf, "lineitem").join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    per = s.groupBy("l_partkey").agg(F.collect_set(F.struct(F.lit("").alias("name"), F.col("s_name").alias("file"), F.lit("").alias("bank"))).alias("sources"))
    text = search.searchable_text(F.lit(""), None, F.col("sources"), "all")
    return per.where(search.matches(search.parse_query(display.phrase_for("3")), text)).select(F.col("l_partkey").alias("p_partkey")).join(read(spark, sf, "part"), "p_partkey", "left_semi")


@query("SELECT doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 ORDER BY n_chars DESC, id")
def rank_band(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("star"), F.col("n_chars").alias("score"))
    return sorting.rank_band(d, 1).select("id")


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT v AS cv FROM e WHERE id = 7)
    SELECT id, round(sqrt(list_sum(list_transform(list_zip(v, cv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) AS d FROM e, c""")
def family_by_distance(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return families.by_distance(rows.where("id = 7"), rows).select("id", F.round("d", 9).alias("d"))
