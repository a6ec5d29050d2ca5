"""The manifest against plain code that builds each tree in lists."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle
from graphloom.llm.merkle import build_manifest, field_digest, fold_path, proof_digest

SCHEMA = "doc_id long, lang string, text string, root string, path int, g string, `a.b` int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests, fanout):
    """(root, siblings of each leaf by level: those left of it, those right)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // fanout * fanout :][:fanout]
            paths[i].append(("".join(run[: place % fanout]), "".join(run[place % fanout + 1 :])))
        level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [place // fanout for place in at]
    return level[0], paths


def plain(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, told(*r[:3]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = plain_tree([x[2] for x in groups[g]], fanout)
    root, upper = plain_tree([trees[g][0] for g in order], fanout) if order else ("", [])
    out = []
    for g, rest in zip(order, upper, strict=True):
        for (_, _, leaf, r), path in zip(groups[g], trees[g][1], strict=True):
            out.append((r[0], leaf, trees[g][0], root, H(*(x for s in path + rest for x in s))))
    return sorted(out, key=str)


def found(spark, rows, fanout):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    leaves = docs.withColumn("leaf", field_digest(F.col("doc_id"), F.col("lang"), F.col("text")))
    made = build_manifest(leaves, "lang", ["doc_id"], fanout=fanout)
    assert made.columns == ["doc_id", "lang", "text", "g", "a.b", "leaf", "subroot", "root", "path"]
    assert made.filter(fold_path(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert made.filter(fold_path(F.sha2("leaf", 256), F.col("path")) == F.col("root")).count() == 0
    out = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")))
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_every_kind_of_row(spark, fanout, monkeypatch):
    monkeypatch.setattr(merkle, "TIER", 30)  # several tiers on few rows
    rows = [(i, "en", f"text {i}") for i in range(131)] + [(i, None, "é ü") for i in range(9)]
    rows += [(1, "fr", None), (None, "", ""), (None, None, None), (-3, "日本", "x" * 100_000)]
    rows += [(7, "de", "same")] * 40 + [(7, "de", "other"), (None, "de", "no id"), (None, "de", "no id")]
    assert found(spark, rows[::-1], fanout) == plain(rows, fanout)


def test_one_leaf_one_group_and_none(spark):
    assert found(spark, [(1, "en", "a")], 2) == plain([(1, "en", "a")], 2)
    rows = [(i, "en", "a") for i in range(3)]
    assert found(spark, rows, 2) == plain(rows, 2)
    assert found(spark, [], 2) == []


def test_a_group_larger_than_a_tier(spark):
    rows = [(i * 7 % 2500, "en", "t") for i in range(2500)] + [(0, "x", "t"), (1, "y", "t")]
    assert found(spark, rows, 2) == plain(rows, 2)
