"""CSV cut into blocks of any size, against the standard library's reader."""

import csv
import io
import random

import pytest
from pyspark.errors import SparkRuntimeException

from graphloom.sources.csv_blocks import csv_records, read_csv_blocks

VALUES = [
    "plain", "", "two\nlines", 'a "quoted" word', "\n", "\r\n", '"', '""', "comma, inside", " blanks ", "é日本🎉",
    "a\n\n\nb", '"\n"\n"', "x" * 50, "cr\rhere", "line\r\nline", "tail\n", ",", "'single'",
]


@pytest.fixture
def blocks_of(spark):
    """Sets how many bytes a block has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def set_size(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)

    yield set_size
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def written(path, rows, end="\n"):
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator=end).writerows(rows)
    path.write_bytes(text.getvalue().encode())
    return text.getvalue()


@pytest.mark.parametrize("size", [5, 37, 100_000])
def test_quotes_and_newlines_at_every_edge(spark, blocks_of, tmp_path, size):
    rng = random.Random(size)
    rows = [["n", "a", "b c"]] + [[str(i), rng.choice(VALUES), rng.choice(VALUES)] for i in range(24)]
    for end in ("\n", "\r\n"):
        path = tmp_path / f"rows{len(end)}.csv"
        written(path, rows, end)
        blocks_of(size)
        got = read_csv_blocks(spark, str(path), with_order=True, null_tokens=()).orderBy("row_order").collect()
        assert [[r["n"], r["a"] or "", r["b c"] or ""] for r in got] == rows[1:]
        assert len({r.row_order for r in got}) == 24
        if size < 100:
            assert spark.read.text(str(path)).rdd.getNumPartitions() > 10


def test_files_by_name_nulls_and_schema(spark, blocks_of, tmp_path):
    written(tmp_path / "a.csv", [["id", "text"], ["1", "x\ny"], ["2", "NA"], ["3", ""]])
    written(tmp_path / "b b.csv", [["text", "more"], ['q"', "7"], ["None", "é\n"]])
    written(tmp_path / "only header.csv", [["id", "text"]])
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.txt").write_text("id\n9\n")
    blocks_of(11)
    rows = read_csv_blocks(spark, str(tmp_path), only_csv=True).collect()
    assert rows[0].__fields__ == ["id", "text", "more"]
    assert sorted(map(tuple, rows), key=str) == sorted(
        [("1", "x\ny", None), ("2", None, None), ("3", None, None), (None, 'q"', "7"), (None, None, "é\n")], key=str
    )
    typed = read_csv_blocks(spark, str(tmp_path), "id long, gone int", only_csv=True)
    assert sorted(map(tuple, typed.collect()), key=str) == [(1, None), (2, None), (3, None), (None, None), (None, None)]


def test_a_value_over_many_blocks_and_an_open_quote(spark, blocks_of, tmp_path):
    long = "\n".join(f'line {i} ""' for i in range(60))
    path = tmp_path / "long.csv"
    written(path, [["a", "b"], ["1", long], ["2", "short"], ["3", long]])
    with path.open("ab") as out:
        out.write(b'4,"never closed\nto the end')
    blocks_of(90)
    got = {r.a: r.b for r in read_csv_blocks(spark, str(path)).collect()}
    assert got == {"1": long, "2": "short", "3": long, "4": "never closed\nto the end"}


def test_first_line_is_the_header(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("\na,b\n1,2\n")
    with pytest.raises(SparkRuntimeException, match="no header"):
        read_csv_blocks(spark, str(path), "a string").collect()
    path.write_bytes("﻿a,b\n\n1,2\n\n".encode())
    assert [tuple(r) for r in read_csv_blocks(spark, str(path)).collect()] == [("1", "2")]


def test_only_edges_are_shuffled(spark, tmp_path):
    written(tmp_path / "x.csv", [["a"], ["1"]])
    plan = csv_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    whole = plan.split("Union")[1].split("HashAggregate")[0].split("ObjectHashAggregate")[0]
    assert "_whole_records" in whole and "Exchange hashpartitioning" not in whole.split("BroadcastExchange")[0]


def test_csv_parallel_writes_with_as_many_tasks_as_it_reads(spark, tmp_path, monkeypatch):
    from graphloom.catalog import text_queries as Q

    docs = spark.createDataFrame([(i, 'a "b"\nc' * i, "en") for i in range(40)], "doc_id long, text string, lang string")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    made = str(tmp_path / "made")
    monkeypatch.setattr(Q, "fresh_path", lambda spark, label: made)
    assert Q.csv_parallel(spark, str(tmp_path)).count() == 40
    assert len(list((tmp_path / "made").glob("*.csv"))) > 1
