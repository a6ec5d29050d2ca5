import random

from pyspark.sql import functions as F

from graphloom.constants import INSTRUCTION_PROMPT
from graphloom.functions import graph_text as G
from graphloom.functions import text as X


def values(spark, texts, *columns):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def texts_of_known_depth(n, seed):
    """``text, depth, lowest``: what stands outside quotes and how deep it ends and dips."""
    rng = random.Random(seed)
    steps = {"(": 1, ")": -1, '"(x)) y"': 0, '"("': 0, "a": 0, " : ": 0, "\n": 0, "é": 0}
    out = []
    for _ in range(n):
        pieces = rng.choices(list(steps), k=rng.randint(0, 20))
        depths = [0]
        for piece in pieces:
            depths.append(depths[-1] + steps[piece])
        tail = '"((' if rng.random() < 0.1 else ""  # a quote that never closes
        out.append(("".join(pieces) + tail, depths[-1], min(depths)))
    return out


# What a piece of text gives in the linear form, for pieces that stand between blanks.
LINEAR_PIECES = {
    "(": ["("], ")": [")"], "/": ["/"], "boy": ["boy"], "(b": ["(", "b"], "b)": ["b", ")"], "))": [")", ")"],
    ":ARG0": [":ARG0"], "x:mod": ["x", ":mod"], "12:30": ["12", ":30"], "a/b": ["a", "/", "b"],
    ":op1(x": [":op1", "(", "x"], "–": ["-"], "a–b": ["a-b"], '"name"': ['"name"'], '"a(b:c/d)"': ['"a(b:c/d)"'],
    '"–"': ['"-"'], '"New York"': ['"New', 'York"'], '"a (b) c"': ['"a', "(", "b", ")", 'c"'],
    '"x 1:2 /"': ['"x', "1", ":2", "/", '"'], "want-01": ["want-01"], "é日本": ["é日本"],
}


def texts_of_known_tokens(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        pieces = [rng.choice(list(LINEAR_PIECES)) for _ in range(rng.randint(1, 14))]
        blanks = [rng.choice([" ", "\n", "  ", "\t", "\u2003", "\n    "]) for _ in pieces]
        text = rng.choice(["", " ", "\n"]) + "".join(p + b for p, b in zip(pieces, blanks))
        yield text, " ".join(t for p in pieces for t in LINEAR_PIECES[p])


def test_parentheses_on_random_texts(spark):
    cases = texts_of_known_depth(1500, 1)
    got = values(spark, [c[0] for c in cases], G.unmatched_open_parens("t"), G.parens_balanced("t"))
    for (text, depth, lowest), (missing, balanced) in zip(cases, got):
        assert missing == max(depth, 0), text
        assert balanced == ("(" in text and ")" in text and depth == 0 and lowest == 0), text


def test_linearize_on_random_texts(spark):
    cases = list(texts_of_known_tokens(1500, 2))
    got = values(spark, [text for text, _ in cases], G.linearize("t"))
    for (text, want), (linear,) in zip(cases, got):
        assert linear == want, text


def test_linearize_details(spark):
    texts = ['(b / boy :name "New York" :time 12:30)', '(x / y :v "a(b")', '(a / b :q "–")']
    assert [v for v, in values(spark, texts, G.linearize("t"))] == [
        '( b / boy :name "New York" :time 12 :30 )',
        '( x / y :v "a(b" )',
        '( a / b :q "-" )',
    ]


def test_repair_inside_quote_stays_broken(spark):
    [(n, repaired)] = values(
        spark, ['(b / boy :name "unclosed'], G.unmatched_open_parens("t"), G.close_open_parens("t")
    )
    assert n == 1 and repaired.endswith(" )")


def test_encode(spark):
    texts = [
        "# ::id 1\n(b~e.1/boy\n  :wiki \"Q 1\" :ARG0-of (g / go-02~e.3,4))",
        '(b / boy :wikipedia "x" :wiki - :note ":wiki y")',
        '(b / boy :q "(c/d" :r "a/b")',
    ]
    assert [v for v, in values(spark, texts, G.encode_graph("t"))] == [
        "( b / boy :ARG0-of ( g / go-02 ) )",
        '( b / boy :wikipedia "x" :note ":wiki y" )',
        '( b / boy :q "(c/d" :r "a/b" )',
    ]


def test_strip_takes_every_blank(spark):
    blanks = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    texts = [f"{blanks}a {b} b{blanks}" for b in blanks]
    for text, (got,) in zip(texts, values(spark, texts, X.strip_unicode("t"))):
        assert got == text.strip()


def test_answers_and_prompts(spark):
    texts = ["x AMR Graph\n (a / b) ", "one AMR Graph\nAMR Graph\n\t(c / d)\n", " none "]
    assert [v for v, in values(spark, texts, X.extract_answer("t", "AMR Graph\n"))] == [
        "(a / b)", "(c / d)", "none",
    ]
    [(full, bare)] = values(
        spark, ["S"], X.render_prompt("t", F.lit("G"), eos="</s>"), X.render_prompt("t")
    )
    assert full == INSTRUCTION_PROMPT.format("S", "G") + "</s>"
    assert bare == INSTRUCTION_PROMPT.format("S", "")


def test_sentences(spark):
    texts = ["A b. C!\n D? ", "", "  \n", 'say ""hi"" " " now. x', None]
    got = values(spark, texts, X.split_sentences("t"), X.first_element(X.split_sentences("t")))
    assert got[0] == (["A b.", "C!", "D?"], "A b.")
    assert got[1] == ([], None) and got[2] == ([], None)
    assert got[3][0] == ["say hi  now.", "x"]
    assert got[4] == (None, None)
    assert values(spark, ["a\\nb"], X.clean_sentence("t")) == [("ab",)]


def test_metadata(spark):
    line = "# ::id x ::id  t_1.1 ::date 2020"
    assert values(spark, [line], X.metadata_id("t")) == [("t_1.1",)]
    assert values(spark, ["# ::snt Hi ::snt  yo "], X.metadata_sentence("t")) == [("yo",)]


def test_ids(spark):
    df = spark.sql("SELECT array(5, 0, 7) AS ids")
    row = df.select(
        X.pad_or_truncate("ids", 5).alias("padded"),
        X.pad_or_truncate("ids", 2).alias("cut"),
        X.attention_mask("ids", 5).alias("mask"),
        X.mask_label_padding("ids").alias("labels"),
        X.mask_prompt_ids("ids", F.lit(2)).alias("answer"),
    ).first()
    assert row.padded == [5, 0, 7, 0, 0] and row.cut == [5, 0]
    assert row.mask == [1, 1, 1, 0, 0] and row.labels == [5, -100, 7]
    assert row.answer == [-100, -100, 7]
    assert values(spark, [":op12", ":op", ":opx"], X.op_number("t")) == [(12,), (None,), (None,)]


def test_completion(spark):
    texts = ["a ### R b ### R c", "no template"]
    got = values(spark, texts, X.prompt_of("t", "### R"), X.completion_of("t", "### R"))
    assert got == [("a ### R b ### R", " c"), ("no template", None)]


def test_completion_labels(spark):
    rows = [
        (0, [1, 7, 8, 2, 7, 8, 3, 4]), (1, [7, 8]), (2, [1, 2, 3]), (3, []), (4, None), (5, [7, 7, 8, 9]),
        (6, [5, 6, 1, 7, 8]), (7, [7, 8, 5, 6, 1, 2]), (8, [1, 7]),
    ]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    got = {r.i: r.v for r in df.select("i", X.completion_labels("ids", [[7, 8], [5, 6, 1]]).alias("v")).collect()}
    n = -100
    assert got == {
        0: [n] * 6 + [3, 4], 1: [n, n], 2: [n] * 3, 3: [], 4: None, 5: [n, n, n, 9], 6: [n] * 5, 7: [n] * 5 + [2],
        8: [n, n],
    }


def test_completion_labels_look_at_no_id_by_itself(spark):
    """The search is one of bytes, without a function called for each id."""
    rows = [(0, [7, None, 8, 7, 8, None, 9]), (1, [None, None]), (2, [7, 7, 7, 78, 8]), (3, [17, 8, 7, 81])]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    made = df.select("i", X.completion_labels("ids", [[7, 8], [7, 7]]).alias("v"))
    n = -100
    assert {r.i: r.v for r in made.collect()} == {0: [n] * 5 + [None, 9], 1: [n, n], 2: [n, n, n, 78, 8], 3: [n] * 4}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "filter(" not in plan
