import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import corpus as C
from graphloom.operators import indexing as I
from graphloom.plans import corpus_build as P
from graphloom.sources import blocks as B
from graphloom.sources import tables as S


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


TRAPS = """# ::id t_1.1 ::date 2020-01-01
# ::snt The boy wants to go.
(w / want-01
   :ARG0 (b / boy :wiki "Boy"))

# a comment
# ::id t_1.2
# ::snt_hu magyar
# ::snt Tea and cake.
(a / and)
  \t
(x / second-01)

# ::snt Without an id
(c / cat
# ::id inside
   :mod (d / dog)
)

# ::snt not closed by a blank line
(z / lost)
"""


TRAP_RECORDS = [
    ("t_1.1", "The boy wants to go.", '(w / want-01\n   :ARG0 (b / boy :wiki "Boy"))'),
    ("t_1.2", "Tea and cake.", "(a / and)"),
    ("t_1.2", "Tea and cake.", "(a / and)\n(x / second-01)"),
    ("inside", "Without an id", "(c / cat\n   :mod (d / dog)\n)"),
]


def random_block_file(rng, graphs):
    """Lines of a block file and its records, made side by side.  Some graphs inherit the id or
    add to the graphs of the sentence before, some get a new id half-way; the last is not ended."""
    lines, records = [], []
    ident = sentence = None
    shown = []
    for n in range(graphs):
        if rng.random() < 0.6:
            ident = f"i{n}"
            lines.append(f"# ::id {ident} ::date 1")
        if rng.random() < 0.7:
            sentence, shown = f"s{n}", []
            lines += [f"# ::snt_hu h{n}", f"# ::snt {sentence}"]
        lines += rng.choices(["", "   ", "# other", f"plain {n}"], k=rng.randint(0, 2))
        body = [f"(g{n} / go-02", *rng.choices([f"  :op1 x{n}", "more", "# other"], k=rng.randint(0, 3)), ")"]
        lines += body[:-1]
        if rng.random() < 0.1:
            ident = f"late{n}"
            lines.append(f"# ::id {ident}")
        lines += [body[-1], rng.choice(["", "  "])]
        shown = [*shown, *body]
        records.append((ident, sentence, "\n".join(shown)))
    return [*lines, "(z / lost)"], records


def read_back(spark, folder, **options):
    records = B.read_graph_blocks(spark, str(folder), **options)
    return rows(records.orderBy("source_file", "pos"), "id", "sentence", "amr_graph")


def test_block_traps(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TRAPS)
    got = read_back(spark, tmp_path)
    assert got == TRAP_RECORDS
    assert read_back(spark, tmp_path, keep_unterminated=True)[-1][2] == "(z / lost)"
    fresh = read_back(spark, tmp_path, reset_fields=True)
    assert fresh[2][:2] == (None, None) and fresh[1][:2] == ("t_1.2", "Tea and cake.")


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_random_block_files_in_small_blocks(spark, tmp_path, newline):
    """Files larger than a read block: what lines inherit is carried over block borders."""
    rng = random.Random(5)
    expected = []
    for k in range(6):
        lines, records = random_block_file(rng, rng.choice([0, 1, 10, 200]))
        (tmp_path / f"f{k}.txt").write_bytes("".join(line + newline for line in lines).encode())
        expected += records
    assert len(expected) > 200
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        assert read_back(spark, tmp_path) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fast_block_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TRAPS)
    got = rows(B.read_graph_blocks_by_paragraph(spark, str(tmp_path)), "id", "sentence")
    assert ("t_1.1", "The boy wants to go.") in got and ("inside", "Without an id") in got


def test_numbered_lines_over_blocks_and_files(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(500)]
    (tmp_path / "a").write_text("\n".join(lines[:321]) + "\n")
    (tmp_path / "b").write_text("\n".join(lines[321:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    try:
        got = rows(I.read_numbered_lines(spark, str(tmp_path)), "line_no", "line")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == list(enumerate(lines))


def test_file_numbers_count_by_value(spark, tmp_path):
    for name in ("part-99999", "part-100000", "part-7"):
        (tmp_path / name).write_text(name + "\n")
    lines = I.read_numbered_lines(spark, str(tmp_path))
    assert sorted(rows(lines, "line_no", "line")) == [(0, "part-7"), (1, "part-99999"), (2, "part-100000")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = I.read_numbered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_zip_needs_equal_lengths(spark, tmp_path):
    (tmp_path / "en").write_text(" one \ntwo\n")
    (tmp_path / "hu").write_text("egy\nkettő\n")
    (tmp_path / "bad").write_text("egy\n")
    paths = [str(tmp_path / n) for n in ("en", "hu", "bad")]
    assert sorted(rows(I.zip_text_files(spark, paths[0], paths[1], "a", "b"), "a", "b")) == [
        ("one", "egy"), ("two", "kettő"),
    ]
    with pytest.raises(ValueError):
        I.zip_text_files(spark, paths[0], paths[2], "a", "b")


def test_row_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = rows(I.with_row_index(df, ["k"]), "idx", "k")
    assert sorted(got) == [(i, i) for i in range(1000)]


def test_positional_split_bounds(spark):
    for n in (0, 1, 7, 19):
        indexed = spark.range(n).withColumnRenamed("id", "idx")
        got = dict(rows(I.positional_split(indexed).groupBy("split").count(), "split", "count"))
        sizes = [int(n * 0.8), int(n * 0.9) - int(n * 0.8), n - int(n * 0.9)]
        assert [got.get(s, 0) for s in ("training", "dev", "test")] == sizes


def test_dedup_by_split(spark):
    df = spark.createDataFrame(
        [("a", "training", 1), ("a", "dev", 2), ("a", "test", 4), ("a", "test", 3),
         (None, "training", 5), (None, "dev", 6), ("b", "training", 8), ("b", "training", 7)],
        "sentence string, split string, n int",
    )
    got = rows(C.dedup_by_split(df, ["n"]), "sentence", "split", "n")
    assert sorted(got, key=str) == sorted([("a", "test", 3), (None, "dev", 6), ("b", "training", 7)], key=str)


def test_dedup_ranks_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS v")
    plan = C.keep_first(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "WindowGroupLimit" in line or "Exchange" in line]
    assert "Final" in lines[0] and "Exchange" in lines[1] and "Partial" in lines[2]


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(None, "x"), ("1", "y"), ("2", "z")], "id string, sentence string")
    right = spark.createDataFrame([(None, "n"), ("1", "e")], "id string, hu_sentence string")
    got = rows(C.attach_translations(left, right), "id", "sentence", "hu_sentence")
    assert set(got) == {(None, "x", "n"), ("1", "y", "e"), ("2", "z", None)}


def test_only_hungarian_nulls_go(spark):
    df = spark.createDataFrame([("1", None, None), ("2", "a", "b")], "id string, sentence string, hu_sentence string")
    got = rows(C.languages_to_rows(df), "id", "sentence", "lang")
    assert set(got) == {("1", None, "EN"), ("2", "a", "EN"), ("2", "b", "HU")}


def test_exact_sample(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    one, two = (sorted(rows(C.exact_sample(df, 500, ["k"], 42), "k")) for _ in range(2))
    assert one == two and len(set(one)) == 500
    assert one != sorted(rows(C.exact_sample(df, 500, ["k"], 43), "k"))
    whole = sorted(rows(df.orderBy(C.draw_key(42, ["k"]), "k").limit(500), "k"))
    assert one == whole
    same = df.select(F.lit(1).alias("k"))  # all keys equal: the pre-filter keeps none or all
    assert C.exact_sample(same, 500, ["k"], 1).count() == 500
    with pytest.raises(ValueError):
        C.exact_sample(df, 20_001, ["k"], 1)
    assert C.exact_sample(df, 20_001, ["k"], 1, at_most=True).count() == 20_000


def test_sample_sorts_only_the_edge(spark):
    df = spark.range(50_000).withColumnRenamed("id", "k")
    plan = C.exact_sample(df, 30_000, ["k"], 1)._jdf.queryExecution().executedPlan().toString()
    assert int(plan.partition("TakeOrderedAndProject(limit=")[2].partition(",")[0]) < 100


def test_unions(spark):
    gold = spark.createDataFrame([("1", "g")], "id string, sentence string")
    synth = spark.createDataFrame([("s", "(a / b)")], "sentence string, amr_graph string")
    assert set(rows(C.union_with_synthetic(gold, synth), "id", "sentence", "amr_graph")) == {
        ("1", "g", None), (None, "s", "(a / b)"),
    }
    assert C.union_with_synthetic(None, synth) is synth
    assert C.union_with_synthetic(None, None, spark).columns == list(C.CORPUS_COLUMNS)


def test_training_table_guards_the_held_out_part(spark):
    corpus = spark.createDataFrame([], C.CORPUS_SCHEMA)
    with pytest.raises(ValueError):
        P.training_table(corpus, None, synthetic_amount=40_001)
    with pytest.raises(ValueError):
        P.evaluation_set("other", corpus=corpus)
    with pytest.raises(ValueError):
        C.filter_language(corpus, "DE")


def test_csv_round_trip_and_missing_values(spark, tmp_path):
    values = [("1", ' a "q",\n(b / c) '), ("2", "None"), ("3", ""), ("4", "NA"), ("5", "x\\y"), ("6", None)]
    df = spark.createDataFrame(values, "id string, v string")
    path = str(tmp_path / "t")
    S.write_csv(df, path)
    assert dict(rows(S.read_csv(spark, path), "id", "v")) == {
        "1": ' a "q",\n(b / c) ', "2": None, "3": None, "4": None, "5": "x\\y", "6": None,
    }
    kept = dict(rows(S.read_csv(spark, path, null_tokens=["NA"]), "id", "v"))
    assert kept["2"] == "None" and kept["4"] is None


def test_csv_of_one_column_keeps_null_rows(spark, tmp_path):
    values = [(None,), ("a",), ("",), (' "q" ',), (None,)]
    S.write_csv(spark.createDataFrame(values, "v string"), str(tmp_path / "t"))
    for multi_line in (True, False):
        got = rows(S.read_csv(spark, str(tmp_path / "t"), multi_line=multi_line), "v")
        assert sorted(got, key=str) == sorted([(None,), ("a",), (None,), (' "q" ',), (None,)], key=str)


def test_csv_by_name(spark, tmp_path):
    folder = tmp_path / "with blank"
    folder.mkdir()
    (folder / "a.csv").write_text('id,sentence,hu_sentence\n1,one,"egy\nkettő"\n')
    (folder / "b.csv").write_text("hu_sentence,extra,id\nhárom,x,3\n")
    (folder / "c.csv").write_text("id,sentence,hu_sentence\n4,four,\n")
    (folder / "d.csv").write_text("")
    got = S.read_translations(spark, str(folder))
    assert got.columns == ["id", "hu_sentence", "source_file", "row_order"]
    assert sorted(rows(got, "id", "hu_sentence")) == [("1", "egy\nkettő"), ("3", "három"), ("4", None)]
    whole = S.read_csv_union(spark, [str(folder / n) for n in ("a.csv", "b.csv", "c.csv")])
    assert sorted(whole.columns) == ["extra", "hu_sentence", "id", "sentence"]
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2


def test_corpus_from_files(spark, tmp_path):
    record = "# ::id {i}\n# ::snt {s}\n(b / boy\n  :wiki \"B\" :mod (s{n} / small))\n\n"
    for n, (split, ident, sentence) in enumerate(
        [("training", "t1", "same"), ("training", "t2", "one"), ("training", "t2", "again"),
         ("dev", "d1", "same"), ("test", "e1", "two"), ("test", "e2", "egy")]
    ):
        folder = tmp_path / split
        folder.mkdir(exist_ok=True)
        with open(folder / "a.txt", "a") as f:
            f.write(record.format(i=ident, s=sentence, n=n))
    folder = tmp_path / "translation"
    folder.mkdir()
    (folder / "a.csv").write_text(
        'id,sentence,hu_sentence\nt2,one,egy\nt2,one,other\ne1,two,"ket ""tő"""\nd1,same,None\n'
    )
    (folder / "notes.txt").write_text("not,a,table\n1,2,3\n")
    got = P.load_corpus(spark, str(tmp_path))
    assert got.columns == list(C.CORPUS_COLUMNS)
    assert set(rows(got, "id", "sentence", "split", "lang")) == {
        ("d1", "same", "dev", "EN"), ("t2", "one", "training", "EN"), ("e1", "two", "test", "EN"),
        ("e2", "egy", "test", "EN"), ("e1", 'ket "tő"', "test", "HU"),
    }
    assert {g for g, in rows(got.filter("id = 't2'"), "amr_graph")} == {
        "( b / boy :mod ( s1 / small ) )"
    }
    text = P.training_text(got.filter("id = 't2'"), eos="</s>").first()["text"]
    assert text.endswith("### AMR Graph\n( b / boy :mod ( s1 / small ) )</s>")


def test_records_inside_a_block_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Records of 50 sentences in one block, some with two graphs: only those under the first and the
    last sentence are dealt out again.  The result does not hang on how many lines a task adds up."""
    lines = []
    for i in range(50):
        lines += [f"# ::id i{i}", f"# ::snt s{i}", f"(a{i} / a", "  :b c)", ""] + [f"(z{i} / z)", ""] * (i % 2)
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    runs = B._runs(B._classified(B.read_lines(spark, str(tmp_path))), False).collect()
    assert len(runs) == 75 and sum(not r.whole for r in runs) == 2  # under the last sentence
    expected = [
        (f"i{i}", f"s{i}", "\n".join([f"(a{i} / a", "  :b c)", f"(z{i} / z)"][: 2 + k]))
        for i in range(50) for k in range(1 + i % 2)
    ]
    assert read_back(spark, tmp_path, keep_unterminated=True) == expected
    for held in (1, 3):
        monkeypatch.setattr(B, "_HELD", held)
        assert read_back(spark, tmp_path, keep_unterminated=True) == expected
