"""Ranking, search, facets, sorting, dedupe: hand-made cases."""

import pytest
from pyspark.sql import functions as F

from sievecraft.operators import dedupe, facets, ranking, search, sorting


def test_source_ranking_counts_an_item_once_and_shrinks(spark):
    entries = spark.createDataFrame([(1, "a/x/f"), (1, "a/y/g"), (2, "a/x/f"), (3, "b/z/h"), (4, "/rooted")], "item long, path string")
    items = spark.createDataFrame([(1, 5, None), (2, 1, 2.0), (3, None, 4.0), (4, None, None)], "item long, rating int, predicted double")
    got = {r.key: r for r in ranking.rank_sources(entries, items, "archive").collect()}
    assert set(got) == {"a", "b", "/rooted"}
    a = got["a"]
    assert (a["items"], a["rated"], a["average"], a["score"], a["expected"]) == (2, 2, 3.0, (6 + 4 * 3) / 6, 3.0)
    assert got["b"].score is None and got["b"].expected == 4.0 and got["/rooted"].expected is None
    order = [r.key for r in ranking.order_sources(ranking.rank_sources(entries, items, "archive"), worst_first=True).collect()]
    assert order[0] == "a" and set(order[1:]) == {"b", "/rooted"}  # those without a score come last either way


def test_source_ranking_without_ratings(spark):
    entries = spark.createDataFrame([(1, "f")], "item long, path string")
    items = spark.createDataFrame([(1, None, None)], "item long, rating int, predicted double")
    r = ranking.rank_sources(entries, items).first()
    assert r.score is None and r.expected is None


VOICES = [("BRASS 1", ["HORNS"]), ("E.PIANO 1", ["RHODES -A-"]), ("INIT VOICE", ["warm, pad"])]


@pytest.mark.parametrize(
    "query,found",
    [
        ("brass", {0}), ("BRASS OR piano", {0, 1}), ("brass,piano", {0, 1}), ("brass horns", {0}), ("brass piano", set()), ("-init", {0, 1}), ("!init", {0, 1}), ("NOT init", {0, 1}),
        ('"e.piano 1"', {1}), ('-"init voice"', {0, 1}), ("", {0, 1, 2}), ("   ", {0, 1, 2}), ("-", {1}), ("piano OR -init", {1}), ('"warm, pad"', set()), ("not", {0, 1, 2}),
    ],
)
def test_search(spark, query, found):
    df = spark.createDataFrame([(i, n, [(a, "file", "bank") for a in aliases]) for i, (n, aliases) in enumerate(VOICES)], "id long, name string, sources array<struct<name:string,file:string,bank:string>>")
    text = search.searchable_text(F.col("name"), None, F.col("sources"))
    got = {r.id for r in df.where(search.matches(search.parse_query(query), text)).collect()}
    assert got == found


def test_search_scope_all_and_wildcards_are_plain_text(spark):
    df = spark.createDataFrame([(0, "100%", [("a", "dir_x", "b")])], "id long, name string, sources array<struct<name:string,file:string,bank:string>>")
    names, both = (search.searchable_text(F.col("name"), None, F.col("sources"), s) for s in ("names", "all"))
    count = lambda q, t: df.where(search.matches(search.parse_query(q), t)).count()
    assert count("dir_x", both) == 1 and count("dir_x", names) == 0 and count("0%", names) == 1 and count("%a", names) == 0


def test_name_tokens(spark):
    df = spark.createDataFrame([("The Brass-brass 12 of abcdefghijklmn horn",), ("",)], "n string")
    assert [r.t for r in df.select(search.name_tokens(F.col("n"), ["THE"]).alias("t")).collect()] == [["BRASS", "HORN"], []]


def test_facets(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 2)], "id long, rating int")
    ids = lambda c: {r.id for r in df.where(c).collect()}
    assert ids(facets.rating_facet(F.col("rating"), 3)) == {1}
    assert ids(facets.rating_facet(F.col("rating"), 3, "or")) == {1, 2}
    assert ids(facets.rating_facet(F.col("rating"), None, "only")) == {2}


def test_polygon_with_a_dent(spark):
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 3.5, 2.0), (4, 5.0, 1.0), (5, -1.0, 0.0)], "id long, x double, y double")
    assert {r.id for r in df.where(facets.in_polygon(F.col("x"), F.col("y"), shape)).collect()} == {1, 3}


def test_upsert_keeps_first_bytes_and_appends_unknown_sources(spark):
    schema = "key string, payload string, sources array<struct<file:string,bank:string,slot:int>>, pinned boolean, user_supplied boolean, seq long"
    old = spark.createDataFrame([("k", "first", [("f", "b", 1)], False, False, 1)], schema)
    new = spark.createDataFrame([("k", "second", [("f", "b", 1), ("g", "b", 2), ("g", "b", 2)], True, False, 1), ("n", "new", [("h", "b", 1)], False, True, 2)], schema)
    got = {r.key: r for r in dedupe.upsert(old, new).collect()}
    k = got["k"]
    assert (k.payload, [tuple(s) for s in k.sources], k.pinned, k.user_supplied, k.is_new, k.merged) == ("first", [("f", "b", 1), ("g", "b", 2), ("g", "b", 2)], True, False, False, 1)
    assert got["n"].is_new and got["n"].user_supplied
    again = dedupe.upsert(dedupe.upsert(old, new).withColumn("seq", F.lit(1).cast("long")).select(*old.columns), new)
    assert [tuple(s) for s in {r.key: r for r in again.collect()}["k"].sources] == [("f", "b", 1), ("g", "b", 2), ("g", "b", 2)]


def test_insert_synthesised_pins_what_exists(spark):
    old = spark.createDataFrame([("a", False)], "key string, pinned boolean")
    new = spark.createDataFrame([("a", False), ("b", True)], "key string, pinned boolean")
    assert {(r.key, r.pinned) for r in dedupe.insert_synthesised(old, new).collect()} == {("a", True), ("b", True)}


def test_point_update_and_replace_named(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    changes = spark.createDataFrame([(1, "x", False), (2, None, True)], "id long, value string, clear boolean")
    assert {(r.id, r.v) for r in dedupe.point_update(df, changes, "id", "v").collect()} == {(1, "x"), (2, None), (3, "c")}


def test_table_order_puts_missing_values_where_their_stand_in_belongs(spark):
    df = spark.createDataFrame([(1, "b", None), (2, None, 3), (3, "A", 5), (4, "", None)], "id long, name string, rating int")
    ids = lambda *a, **k: [r.id for r in sorting.table_order(df, *a, **k).collect()]
    assert ids("name", "text") == [3, 1, 2, 4] and ids("name", "text", descending=True) == [2, 4, 1, 3]
    assert ids("rating", "rating") == [1, 4, 2, 3] and ids("name", "text", collation="UNICODE")[0:1] == [2] or ids("name", "text", collation="UNICODE")[0] in (2, 3)


def test_next_pair_skips_asked_ones(spark):
    s = spark.createDataFrame([(0, 1, 1500.0, 0), (0, 2, 1501.0, 3), (0, 3, 1600.0, 3)], "band int, id long, score double, games int")
    asked = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [(r.first, r.second) for r in sorting.pair_candidates(s, asked).collect()] == [(1, 3)]
    assert sorting.next_pair(s, asked).select("first", "second").first() == (1, 3)
