import pytest
from pyspark.sql import functions as F

from graphloom.operators.infer import batch_infer, score_translations
from graphloom.plans.generation import evaluate_file, generate_file, prepare_sentences
from graphloom.sources.tables import read_csv, write_csv
from graphloom.streaming.incremental import generate_stream, read_drops


def test_batches_have_the_asked_size(spark):
    df = spark.range(0, 100, numPartitions=2).withColumn("s", F.col("id").cast("string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = batch_infer(df, lambda: lambda b: [len(b)] * len(b), "s", "n", output_type="int",
                          batch_size=16).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert sorted(r.n for r in got) == [2] * 4 + [16] * 96
    assert all(str(r.id) == r.s for r in got)


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda batch: [os.getpid()] * len(batch)

    df = spark.range(0, 400, numPartitions=40).withColumn("s", F.col("id").cast("string"))
    for _ in range(2):  # the second time as another job, like a next micro-batch
        rows = batch_infer(df, load, "s", "pid", output_type="long").collect()
        assert len(rows) == 400
    loads = [name.split("-")[0] for name in (p.name for p in tmp_path.iterdir())]
    assert len(loads) == len(set(loads)) < 40
    assert {str(r.pid) for r in rows} <= set(loads)


def test_like_lengths_share_a_batch_and_rows_keep_their_place(spark):
    df = spark.range(0, 96, numPartitions=1).select("id", F.repeat(F.lit("x"), (F.col("id") % 3 * 10).cast("int")).alias("s"))
    rows = batch_infer(
        df, lambda: lambda b: [f"{len(t)}:{max(map(len, b)) - min(map(len, b))}" for t in b], "s", "n", by_length=True
    ).collect()
    assert [r.id for r in rows] == list(range(96))
    assert [r.n for r in rows] == [f"{i % 3 * 10}:0" for i in range(96)]


def test_wrong_output_count_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "s string")
    with pytest.raises(Exception, match="outputs"):
        batch_infer(df, lambda: lambda b: [], "s", "n").collect()


def test_pair_scores(spark):
    df = spark.createDataFrame([("ab", "abcd")], "sentence string, hu_sentence string")
    row = score_translations(df, lambda: lambda ps: [len(p["src"]) / len(p["mt"]) for p in ps]).first()
    assert row.asDict() == {"src": "ab", "mt": "abcd", "score": 0.5}


def test_prepared_sentences(spark):
    df = spark.createDataFrame(
        [("1", "u1", "index.hu", "Egy. Kettő."), ("2", "u2", "other", "No."), ("3", "u3", "index.hu", "")],
        "uuid string, url string, domain string, lead string",
    )
    assert {tuple(r) for r in prepare_sentences(df, n=2).collect()} == {
        ("1", "u1", "Egy."), ("3", "u3", None),
    }
    with pytest.raises(ValueError):
        prepare_sentences(df, n=3)


echo = lambda: lambda prompts: [p + " (s / size :n 1) " for p in prompts]


def test_files_in_and_out(spark, tmp_path):
    src, out, scored = (str(tmp_path / n) for n in ("in", "out", "scored"))
    write_csv(spark.createDataFrame([("x",), ('y "z"\n w',)], "sentence string"), src)
    generate_file(spark, src, out, echo)
    made = read_csv(spark, out)
    assert {tuple(r) for r in made.collect()} == {
        ("x", "(s / size :n 1)"), ('y "z"\n w', "(s / size :n 1)"),
    }
    report = evaluate_file(spark, out, "generated_amr", "sentence", scored).first()
    assert report.unparsable == 2 and report.f1_mean == 0.0
    report = evaluate_file(spark, out, "generated_amr", "generated_amr", scored).first()
    assert report.unparsable == 0 and report.f1_mean == 1.0


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    drops, out, progress = (str(tmp_path / n) for n in ("drops", "out", "progress"))
    for n in (1, 2, 2):
        if n == 1 or not (tmp_path / "second").exists():
            spark.createDataFrame([(f"s{n}",)], "sentence string").write.mode("append").json(drops)
        if n == 2:
            (tmp_path / "second").touch()
        generate_stream(
            read_drops(spark, drops, "sentence string"), echo, out, progress
        ).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("sentence", "generated_amr").collect())
    assert got == [("s1", "(s / size :n 1)"), ("s2", "(s / size :n 1)")]


def test_few_inputs_are_python_values_at_a_time(spark):
    """However many rows an Arrow batch has, a task turns only some of them into Python values at once."""

    def load():
        import gc

        def count(batch):
            alive = sum(isinstance(x, list) and len(x) > 1000 and isinstance(x[0], str) and x[0].startswith("~~")
                        for x in gc.get_objects())
            return [alive] * len(batch)

        return count

    df = spark.range(0, 5000, numPartitions=1).withColumn("s", F.concat(F.lit("~~"), "id"))
    for by_length in (False, True):
        rows = batch_infer(df, load, "s", "n", output_type="int", batch_size=500, by_length=by_length).collect()
        assert [r.id for r in rows] == list(range(5000)) and {r.n for r in rows} == {0}
