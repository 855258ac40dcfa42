"""Streams give what the batch gives."""

import pytest
from pyspark.sql import functions as F

from sievecraft.operators import elo
from sievecraft.plans import models, streams
from sievecraft.streaming import stateful


@pytest.mark.parametrize("cut", range(1, 9))
def test_reassembly_at_any_cut(cut):
    data = bytes([1, 0xF0, 2, 3, 0xF7, 9, 0xF0, 4, 0xF0, 5, 0xF7, 0xF7])
    buffer, out = None, []
    for k in range(0, len(data), cut):
        buffer, done = stateful.feed(buffer, data[k : k + cut])
        out += done
    assert out == [bytes([0xF0, 2, 3, 0xF7]), bytes([0xF0, 5, 0xF7])] and buffer is None


def test_long_messages_stay_unless_a_bound_is_given():
    long = bytes([0xF0]) + bytes(3 << 20)
    buffer, out = stateful.feed(*[stateful.feed(None, long)[0]], bytes([1, 0xF7]))
    assert buffer is None and out == [long + bytes([1, 0xF7])]


def test_a_message_without_end_is_given_up_beyond_a_bound():
    buffer, out = stateful.feed(None, bytes([0xF0]) + bytes(100), longest=50)
    assert buffer is None and out == []


def test_streamed_elo_equals_batch(spark, small):
    got = {(r.band, r.id): (round(r.score, 6), r.games) for r in streams.stream_elo(spark, small).collect()}
    assert got == {(r.band, r.id): (round(r.score, 6), r.games) for r in models.elo_fold(spark, small).collect()}


def test_streamed_windows_are_among_the_batch_windows(spark, small):
    batch = {(r.start, r.event_type): (r.n, r.total) for r in models.tumbling_counts(spark, small).collect()}
    got = {(r.start, r.event_type): (r.n, r.total) for r in streams.stream_tumbling(spark, small).collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and len(got) >= 0.9 * len(batch)


def test_incremental_ingest_computes_a_row_once(spark, tmp_path):
    seen = []
    compute = lambda df: (seen.append(df.count()), df.withColumn("f", F.col("id") * 2))[1]
    write = stateful.incremental(compute, str(tmp_path / "t"), "id")
    write(spark.range(3), 0)
    write(spark.range(5), 1)
    write(spark.range(5), 2)
    assert seen == [3, 2, 0] and spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_refit_trigger_counts_judgements_over_batches(spark):
    fits = []
    t = stateful.RefitTrigger(fits.append)
    one = spark.createDataFrame([(True,), (False,), (True,)], "new boolean")
    for n in range(8):
        t(one, n)
    assert fits == [8, 16] and elo.refit_points(list(range(1, 25)))[0] == 9
