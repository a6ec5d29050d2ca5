"""Appending sinks: repeated batches, stops in the middle, a second stream."""

import pytest
from pyspark.sql import functions as F

from graphloom.sources.tables import write_csv, write_pair_blocks
from graphloom.streaming import sinks as K
from graphloom.streaming.incremental import read_drops


def batch(spark, *ids):
    return spark.createDataFrame([(i, f'text "{i}"\nmore') for i in ids], "id long, text string")


def read(spark, path):
    return sorted((r.id, r.text) for r in K.read_csv_batches(spark, path, "id long, text string").collect())


def rows(*ids):
    return [(i, f'text "{i}"\nmore') for i in ids]


def test_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path)
    assert K.complete_batches(spark, path).count() == 0
    assert K.write_batch(batch(spark, 1, 2), path, 0)
    assert K.write_batch(batch(spark, 3), path, 1)
    assert not K.write_batch(batch(spark, 3), path, 1)
    assert read(spark, path) == rows(1, 2, 3)
    assert K.write_batch(batch(spark, 4), path, 0, run="other")
    assert read(spark, path) == rows(1, 2, 3, 4)


def test_a_stop_in_the_middle_is_not_seen_and_then_repeated(spark, tmp_path):
    path = str(tmp_path)
    K.write_batch(batch(spark, 1), path, 0)

    def half(df, folder):
        write_csv(df.limit(1), folder)
        raise OSError("stopped")

    with pytest.raises(OSError):
        K.write_batch(batch(spark, 2, 3), path, 1, half)
    assert read(spark, path) == rows(1)
    assert K.write_batch(batch(spark, 2, 3), path, 1)
    assert read(spark, path) == rows(1, 2, 3)


def test_stream_goes_on_after_a_failed_batch(spark, tmp_path):
    drops, sink, progress = (str(tmp_path / n) for n in ("drops", "sink", "progress"))
    calls = []

    def breaks_once(df, folder):
        calls.append(folder)
        write_csv(df, folder)
        if len(calls) == 2:
            raise OSError("stopped")

    for i in (1, 2):
        batch(spark, i).coalesce(1).write.mode("append").json(drops)
    for attempt in range(3):
        stream = read_drops(spark, drops, "id long, text string", files_per_batch=1)
        query = K.write_stream(stream, sink, progress, breaks_once)
        if attempt == 0:
            with pytest.raises(Exception, match="stopped"):
                query.awaitTermination()
            assert [len(read(spark, sink))] == [1]
        else:
            query.awaitTermination()
            assert read(spark, sink) == rows(1, 2)
    assert len(calls) == 3 and calls[1] == calls[2]


def test_pair_blocks(spark, tmp_path):
    path = str(tmp_path)
    pairs = spark.createDataFrame([("egy", "(a / b)"), ("kettő", "(c / d\n  :mod e)")], "hu_sentence string, block string")
    for _ in range(2):
        K.write_batch(pairs, path, 0, write_pair_blocks)
    got = K.read_pair_batches(spark, path).select("sentence", "amr_graph").collect()
    assert sorted(map(tuple, got)) == [("_hu egy", "(a / b)"), ("_hu kettő", "(c / d\n  :mod e)")]


def test_empty_sink(spark, tmp_path):
    empty = batch(spark, 1).filter(F.lit(False))
    K.write_batch(empty, str(tmp_path), 0)
    assert K.complete_batches(spark, str(tmp_path)).count() == 1
