"""Heads and tails by the key of a row."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import indexing as I


@pytest.fixture
def short_rounds(monkeypatch):
    monkeypatch.setattr(I, "_SORTED", 10)
    monkeypatch.setattr(I, "_CUTS", 5)


@pytest.mark.parametrize("n", [0, 1, 2, 137, 499, 500, 501])
def test_any_row_of_mixed_keys(spark, short_rounds, n):
    rows = [((i * 37) % 11 if i % 5 else None, f"é{(i * 7919) % 500:03d}" if i % 9 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, c long").repartition(7)
    order = ["a", F.lower("b"), "c"]
    want = [r.c for r in df.orderBy(*order).collect()]
    head, tail = I.split_at(df, order, n)
    assert sorted(r.c for r in head.collect()) == sorted(want[:n])
    assert sorted(r.c for r in tail.collect()) == sorted(want[n:])


def test_one_key_holds_most_rows(spark, short_rounds):
    df = spark.range(400).select(F.greatest(F.col("id"), F.lit(300)).alias("k"))
    assert I.split_at(df, ["k"], 301)[0].count() == 301
    assert I.split_at(df, ["k"], 350)[1].count() == 50
    with pytest.raises(ValueError, match="row 200"):
        I.split_at(df, ["k"], 200)


def test_no_row_is_moved(spark):
    df = spark.range(100).withColumn("text", F.lit("long"))
    for side in I.split_at(df, ["id"], 40):
        assert "Exchange" not in side._jdf.queryExecution().executedPlan().toString()
