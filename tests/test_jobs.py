"""From a folder of files to banks, end to end."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_records import packed, record, sine

from sievecraft.functions import codecs
from sievecraft.operators import category, display
from sievecraft.plans import jobs
from sievecraft.sources import banks, files


def voiced(seed):
    """A record that surely sounds."""
    v = bytearray(record(seed))
    for op in range(6):
        v[op * 21 + 16] = max(v[op * 21 + 16], 60)
        v[op * 21 : op * 21 + 8] = bytes([90, 60, 50, 70, 99, 95, 90, 0])
    v[145:155] = f"VOICE {seed:<4}".encode()
    return codecs.pack_bytes(bytes(v))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    own = [voiced(s) for s in range(32)]
    (folder / "a.syx").write_bytes(banks.build_bank(own))
    near = []
    for s in range(8):  # all but the same
        v = bytearray(codecs.unpack_bytes(own[s]))
        v[137] = (v[137] + 1) % 100
        near.append(codecs.pack_bytes(bytes(v)))
    with zipfile.ZipFile(folder / "more.zip", "w") as z:
        z.writestr("dir/b.syx", banks.build_bank(own[:16] + near + [bytes(128)] * 8))
        z.writestr("notes.txt", "nothing")
    (folder / "bad.zip").write_bytes(b"not an archive")
    (folder / "readme.txt").write_text("nothing")
    s = jobs.Store(spark, str(tmp_path_factory.mktemp("store")))
    return s, folder, own, near


def test_ingest_merges_copies_and_is_repeatable(store):
    s, folder, own, near = store
    tally = {r.reason: r.n for r in jobs.ingest(s, str(folder)).collect()}
    assert tally["taken"] == 32 + 24 and tally["zero"] == 8 and tally["unreadable"] == 1
    voices = s.voices.read()
    assert voices.count() == 40 and voices.where(F.size("sources") == 2).count() == 16
    before = {(r.id, len(r.sources)) for r in voices.collect()}
    jobs.ingest(s, str(folder))
    assert {(r.id, len(r.sources)) for r in s.voices.read().collect()} == before


def test_analyse_cluster_categorize_build(store, tmp_path):
    s, folder, own, near = store
    if not s.voices.count():
        jobs.ingest(s, str(folder))
    assert jobs.analyse(s, rate=11025) == 40 and jobs.analyse(s, rate=11025) == 0
    levels = {r.id: r for r in jobs.cluster(s).collect()}
    ids = {bytes(r.packed): r.id for r in s.voices.read().collect()}
    together = sum(levels[ids[a]].family == levels[ids[b]].family for a, b in zip(own, near))
    assert len(levels) == 40 and together >= 6
    kinds = jobs.categories(s).collect()
    assert len(kinds) == 40 and all(r.category in category.CATEGORIES and r.subcategory in category.SUBCATEGORIES[r.category] for r in kinds)
    judgements = s.voices.read().select("id", (F.pmod("id", F.lit(5)) + 1).cast("double").alias("rating"), (F.pmod("id", F.lit(11)) == 0).alias("pinned"), F.lit(0.0).alias("tie_break"))
    assert jobs.build(s, judgements, str(tmp_path / "out"), packed(1), total=36) == []
    made = s.spark.read.parquet(str(tmp_path / "out/banks")).collect()
    assert sorted(r.bank for r in made) == [0, 1]
    assert jobs.export_all(s, packed(1)).count() == 2


def test_manifest_and_colours(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"bundles": [{"name": "x", "file": "x.gz", "voices": 3}, {"name": "", "file": "y", "voices": 1}, {"name": "z", "file": "z"}]}')
    assert [r.name for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()] == ["x"]
    df = spark.createDataFrame([("keys", 5), ("none", 0)], "c string, r int")
    rows = df.select(display.category_colour(F.col("c")).alias("a"), display.rating_colour(F.col("r")).alias("b")).collect()
    assert all(0 <= x <= 255 for r in rows for x in [*r.a, *r.b]) and rows[0].a[2] > rows[0].a[0] and np.ptp(rows[1].a) < 10
    groups = display.grouped_axes(["attack", "own", "lfoPm"])
    assert groups == {"Envelope": ["attack"], "LFO": ["lfoPm"], "Other": ["own"]}
    assert display.important_axes([0.1, -3, 2], ["a", "b", "c"], 0.5, 2) == ["b", "c"] and display.important_axes([1], ["a"], 0.01) == []
    assert display.density_scale(1400, 800, 35000) == 1 and display.density_scale(10, 10, 0) == 1


def test_sine_is_no_noise():
    assert sine()[134] == 31
