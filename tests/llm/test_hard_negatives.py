"""Hard negatives against plain code that scores all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hard_negatives as module
from graphloom.llm.hard_negatives import hard_negatives, scores_by_tree, spanning_tree, tree_levels

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, dim string, `a.b` int"


def whole(rows):
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        yield i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(np.int64), label


def plain(rows, modulo, positives=5, negatives=5):
    kept = list(whole(rows))
    out = []
    for a, x, own in kept:
        if a % modulo:
            continue
        scored = [(-int(x @ y), i, label) for i, y, label in kept if len(y) == len(x)]
        best = sorted((s, i) for s, i, label in scored if label == own and i != a)[:positives]
        for p, pid in best:
            fits = sorted((s, i) for s, i, label in scored if label != own and -80 * p <= -100 * s <= -100 * p)
            out += [(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(spark, rows, modulo):
    vectors = spark.createDataFrame([(*r, 9, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives(vectors, F.col("vec_id") % modulo == 0).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(module, "ANCHORS", 8)
    monkeypatch.setattr(module, "CANDIDATES", 16)


def vectors_near(draw, n, centres, dim, spread):
    middle = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [
        (i, [m + draw.gauss(0, spread) for m in middle[i % centres]], draw.randrange(4)) for i in range(n)
    ]


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_random_vectors(spark, small_blocks, spread):
    rows = vectors_near(random.Random(5), 300, 6, 12, spread)
    assert found(spark, rows, 7) == plain(rows, 7)


def test_every_kind_of_row(spark, small_blocks):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (10, [0.5, 0.5], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], 2),
        (4, [0.9, 0.1], 2), (5, [0.9, 0.1], 3), (6, [0.9, 0.1], 3), (7, [0.9, 0.1], 4), (8, [0.9, 0.1], 4),
        (9, [1.0, nan], 1), (11, [1.0, inf], 2), (12, [1.0, None], 2), (13, None, 1), (14, [1.0, 0.0], None),
        (None, [1.0, 0.0], 2), (15, [], 1), (20, [], 1), (16, [], 2), (30, [1.0, 0.0, 0.0], 5),
        (31, [1.0, 0.0, 0.0], 5), (32, [0.9, 0.0, 0.0], 6), (40, [-1.0, 0.0], 7), (41, [1.0, 0.0], 7),
        (42, [-0.9, 0.0], 8), (-10, [0.7, 0.7], 1), (50, None, 1), (60, [1.0, 0.0], None),
    ]
    got = found(spark, rows, 10)
    assert got == plain(rows, 10)
    assert [r for r in got if r[0] == 0 and r[1] == 1][0][3] == 2  # a tie goes to the smaller id
    assert found(spark, rows, 1) == plain(rows, 1)


def test_repeated_rows_and_one_hot_vector(spark, small_blocks):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(150)] + [(200, [0.5, 1.0], 1)] + [(7, [1.0, 0.5], 1)] * 3
    assert found(spark, rows, 50) == plain(rows, 50)


def test_no_anchor_and_empty_table(spark):
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)], 10) == []
    assert found(spark, [], 10) == []


def test_bounds_spare_exact_scores():
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 400, (5, 16))
    anchors = np.rint(np.repeat(centres, 20, axis=0) + draw.normal(0, 2, (100, 16))).astype(np.int64)
    rows = np.rint(draw.normal(0, 300, (2000, 16))).astype(np.int64)
    order, parent, edge = spanning_tree(anchors)
    levels = tree_levels(order, parent)
    assert sorted(order) == list(range(100)) and sum(map(len, levels)) == 100
    want = anchors @ rows.T
    least = np.sort(want, axis=1)[:, -5]
    asked = 0
    for at, needed, scores in scores_by_tree(
        anchors, levels, parent, edge, rows, lambda at: (least[at][:, None], np.inf),
        lambda at: np.ones((len(at), len(rows)), bool),
    ):
        assert (scores[needed] == want[at][needed]).all()
        assert (needed | (want[at] < least[at][:, None])).all()  # nothing within a window is missed
        asked += needed.sum()
    assert asked < 0.1 * want.size
