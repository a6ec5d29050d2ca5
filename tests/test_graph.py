import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from graphloom.functions import graph_text as G
from graphloom.operators import graph as GR
from graphloom.operators import stats as ST
from graphloom.operators import validate as V
from graphloom.sources.lexicon import lexicon_rows, read_lexicon

VALID = [
    "(b / boy)",
    "(b/boy)",
    "(w / want-01 :ARG0 (b / boy) :ARG1 (g / go-02 :ARG0 b))",
    '(b / boy :name ")" :mod "a : / (")',
    "(b / boy :polarity - :ARG0-of (g / go-02))",
    "(t / temporal :time 12:30 :value 1/2)",
    "# ::id 7\n(b / boy\n   :mod (s / small))",
]
BROKEN = [
    "", "boy", "(b)", "(b / boy", "(b / boy))", "(b / boy) (c / cat)", "(b / boy) tail",
    "(b / boy :ARG0)", "(b / boy :ARG0 :ARG1 c)", "(b / boy c)", "(b / boy (c / cat))",
    '(b / boy :name "x)', "(/ boy)", "(b / )", "(b / / boy)", ":ARG0 (b / boy)", ")b(",
    "(b / boy :mod /)", "((b / boy))", "(b / :ARG0 c)", "(a / b)) :x (c / d", None,
]


def decode(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return GR.decode_graphs(df, "t", **options)


def triples(spark, text, **options):
    rows = GR.explode_triples(decode(spark, [text], **options)).orderBy("pos").collect()
    return [(r.source, r.role, r.target) for r in rows]


@pytest.mark.parametrize("texts, expected", [(VALID, True), (BROKEN, False)])
def test_well_formed(spark, texts, expected):
    for row in decode(spark, texts).collect():
        assert row.decoded is expected, row.t
        assert (row.triples is not None) is expected


def test_triples_in_text_order(spark):
    assert triples(spark, VALID[2]) == [
        ("w", ":instance", "want-01"), ("w", ":ARG0", "b"), ("b", ":instance", "boy"),
        ("w", ":ARG1", "g"), ("g", ":instance", "go-02"), ("g", ":ARG0", "b"),
    ]


def test_inverse_roles(spark):
    text = '(b / boy :ARG0-of (g / go-02) :domain-of "x" :consist-of g)'
    assert triples(spark, text) == [
        ("b", ":instance", "boy"), ("g", ":ARG0", "b"), ("g", ":instance", "go-02"),
        ("b", ":domain-of", '"x"'), ("g", ":consist", "b"),
    ]
    kept = triples(spark, text, non_inverse_roles=[":consist-of"])
    assert kept[-1] == ("b", ":consist-of", "g")


def test_kinds_depth_and_alignment(spark):
    df = decode(spark, ['(b~e.1 / boy~e.2 :ARG0~e.3,4 (c / cat :q "~e.5") :ARG1 c~1)'])
    rows = GR.explode_triples(df).orderBy("pos").collect()
    assert [(r.role, r.target, r.kind, r.depth) for r in rows] == [
        (":instance", "boy", "instance", 1), (":ARG0", "c", "edge", 1),
        (":instance", "cat", "instance", 2), (":q", '"~e.5"', "attribute", 2),
        (":ARG1", "c", "edge", 1),
    ]


def random_graph(rng, size):
    """Text of a random graph and its triples, written side by side."""
    found, count = [], 0

    def node(depth):
        nonlocal count
        count += 1
        var, concept = f"v{count}", rng.choice(["and", "go-02", "x", "city"])
        found.append((var, ":instance", concept))
        parts = [f"({var} / {concept}"]
        while count < size and rng.random() < 0.8 and depth < 40:
            role = rng.choice([":ARG0", ":op1", ":mod"])
            at = len(found)
            child, text = node(depth + 1)
            found.insert(at, (var, role, child))
            parts.append(f"{role} {text}")
        if rng.random() < 0.3:
            found.append((var, ":quant", "5"))
            parts.append(":quant 5")
        return var, rng.choice([" ", "\n  "]).join(parts) + ")"

    _, text = node(0)
    return text, found


def test_random_graphs_of_all_sizes(spark):
    rng = random.Random(3)
    made = [random_graph(rng, size) for size in [1, 2, 5, 20, 60, 300, 1500] * 8]
    got = decode(spark, [text for text, _ in made]).orderBy("i").collect()
    for row, (text, expected) in zip(got, made):
        assert [(t.source, t.role, t.target) for t in row.triples] == expected, text


def test_filters_do_not_repeat_the_decoding(spark):
    plan = (
        decode(spark, VALID).filter("decoded").filter("i > 0")
        ._jdf.queryExecution().optimizedPlan().toString()
    )
    # The pattern that marks the steps stands in the plan once, and so does the fold.
    assert plan.count(G._STEP) == 1 and plan.count("aggregate(sequence(") == 1
    assert "Exchange" not in plan


def test_statistics(spark):
    decoded = decode(spark, [VALID[2], VALID[0], BROKEN[1]])
    assert [tuple(r) for r in ST.concept_counts(decoded).collect()] == [
        ("boy", 2), ("go-02", 1), ("want-01", 1),
    ]
    assert [tuple(r) for r in ST.top_concept_counts(decoded).collect()] == [
        ("boy", 1), ("want-01", 1),
    ]


def test_wiki(spark):
    decoded = decode(spark, ['(b / boy :wiki "B" :wikipedia "C")'])
    kept = GR.remove_wiki_triples(GR.explode_triples(decoded)).orderBy("pos").collect()
    assert [r.role for r in kept] == [":instance", ":wikipedia"]


AND_OR = [
    ("(a / and :op1 (t / tea) :op2 (c / cake))", True),
    ("(a / and :op1 (t / tea))", False),
    ("(a / and :op2 (t / tea))", True),
    ("(a / and :op2 (t / tea) :op1 (c / cake))", False),
    ("(a / or)", False),
    ("(a / and :opx (t / tea) :op1 t)", False),
    ("(a / and :op2 (o / or :op1 (x / y)))", True),  # the first single op2 ends the check
    ("(a / and :op1 (o / or :op1 (x / y)) :op2 x)", False),
    ("(n / name :op1 \"x\")", True),
]


def test_connectives(spark):
    df = decode(spark, [t for t, _ in AND_OR])
    got = df.select("i", V.connectives_numbered("triples").alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [ok for _, ok in AND_OR]


@pytest.fixture(scope="module")
def lexicon(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lex") / "frames.txt"
    path.write_text(
        "want-01  ARG0: wanter  ARG1: thing: wanted\n"
        "go-02  ARG0: old entry  ARG4: gone\n"
        "go-02  ARG0: goer  bare part\n"
    )
    return read_lexicon(spark, str(path))


def test_lexicon(lexicon):
    assert {tuple(r) for r in lexicon_rows(lexicon).collect()} == {
        ("want-01", "ARG0", "wanter"), ("want-01", "ARG1", "thing: wanted"),
        ("go-02", "ARG0", "goer"), ("go-02", "bare part", ""),
    }


FRAMES = [
    ("(g / go-02 :ARG4 (h / home))", False),
    ('(g / go-02 :ARG4 "home")', True),
    ("(u / unknown-99 :ARG9 (h / home))", True),
    ("(h / home :ARG0-of (g / go-02))", True),
    ("(h / home :ARG3-of (g / go-02))", False),
    ("(w / want-01 :ARG1 (g / go-02 :ARG0 w) :mod (x / y))", True),
]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_frames_with_and_without_broadcast(spark, lexicon, limit):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FRAMES)], "i int, t string")
    got = V.validate_graphs(df, "t", ["i"], lexicon, max_lexicon_rows=limit).orderBy("i").collect()
    assert [r.frames for r in got] == [ok for _, ok in FRAMES]


def test_chain_names_the_first_failure(spark, lexicon):
    texts = {
        "(b / boy": "parentheses", '(b / boy) "': "decodes", "(b / boy :mod (b / x))": "parses",
        "(g / go-02 :ARG4 (a / and))": "frames", "(a / and)": "and_or", "(b / boy)": None,
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for row in V.validate_graphs(df, "t", ["t"], lexicon).collect():
        assert row.first_failure == (texts[row.t] if row.t else "parentheses")
        assert row.valid == (row.first_failure is None)


def test_valid_filter_counts_in_one_pass(spark):
    texts = ["(b / boy\n)", "(b / boy", "(b / boy :x (b / b))", "(b / b :wiki (c / c))", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    seen = Observation()
    assert V.filter_valid(df, "t", seen).collect() == [("(b / boy\n)",)]
    assert seen.get == {"rows": 5, "dropped": 4}


def test_damage_outside_quotes_is_repaired(spark):
    text = '(w / want-01 :ARG0 (b / boy :name "a(b)") :ARG1 (g / go-02))'
    cuts = [text[:n] for n in range(1, len(text) + 1) if text[:n].count('"') % 2 == 0]
    df = spark.createDataFrame([(c,) for c in cuts], "t string")
    fixed = df.select("t", G.close_open_parens("t").alias("r"))
    assert fixed.filter(~G.parens_balanced("r")).filter(F.col("t") != "(").count() == 0


def test_checks_inside_large_graphs(spark):
    """Core roles and connectives of thousands of nodes, a re-entrant and a repeated variable."""
    n = 3000
    ops = " ".join(f":op{i} (p{i} / part-{i} :ARG1 (m{i} / thing) :ARG2 a)" for i in range(1, n))
    cases = [
        (0, f"(a / and {ops})", True),
        (1, f"(a / and {ops} :op7 (z / end))", False),
        (2, "(a / and :op1 (b / x) :op2 (b / y :ARG0 a) :ARG3 b)", True),
        (3, "(r / root :ARG0 (o / or :op2 (b / x)) :ARG1 (a / and :op1 (c / y)))", True),
        (4, "(r / root :ARG0 (a / and :op1 (c / y)) :ARG1 (o / or :op2 (b / x)))", False),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "i int, g string")
    decoded = GR.decode_graphs(df, "g")
    flags = dict(decoded.select("i", V.connectives_numbered("triples")).collect())
    assert flags == {i: ok for i, _, ok in cases}
    roles = sorted(map(tuple, V.core_roles(decoded, ["i"]).filter("i IN (0, 2)").collect()))
    large = [(0, f"part-{i}", label) for i in range(1, n) for label in ("ARG1", "ARG2")]
    assert roles == sorted([*large, (2, "x", "ARG0"), (2, "y", "ARG0"), (2, "and", "ARG3")])


def test_closing_parentheses_are_no_steps_of_their_own(spark):
    texts = ["(a / b :c (d / e))", "( a / b :c ( d / e ) )", "(a / b :c (d / e\n)\t)", "(a / b :c d))", "() (a / b)"]
    df = decode(spark, texts).withColumn("n", F.size(F.split(G.mark_steps("t"), "\x1e")) - 1)
    rows = df.orderBy("i").collect()
    assert [r.n for r in rows[:3]] == [2, 2, 2]
    assert [r.decoded for r in rows] == [True, True, True, False, False]
    assert rows[0].triples == rows[1].triples == rows[2].triples


def test_deep_graphs(spark):
    deep = "(r / x" + "".join(f" :a (v{i} / x" for i in range(5000)) + " )" * 5001
    row = decode(spark, [deep]).first()
    assert row.decoded and row.triples[-1].depth == 5001 and row.triples[-2].source == "v4998"


def test_orders_are_spread_over_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    from graphloom.catalog import order_graphs as O

    monkeypatch.setattr(O, "_ORDERS_PER_TASK", 10)
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    orders = [(i % 290 if i % 50 else None, i % 7, "OFP"[i % 3], float(i), "1-URGENT") for i in range(300)]
    spark.createDataFrame(orders, columns).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, f"c{i}") for i in range(7)], "c_custkey long, c_name string").write.parquet(
        str(tmp_path / "customer.parquet")
    )
    facts = O.order_facts(spark, str(tmp_path))
    assert facts.rdd.getNumPartitions() == 30
    assert facts.count() == 300
    placed = facts.select("gid", F.spark_partition_id().alias("task"))
    places = placed.groupBy("gid").agg(F.count_distinct("task").alias("n"))
    assert places.filter("n > 1").count() == 0
