"""Substring dedup against plain code that keeps every window as words."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm.substring_dedup import repeated_intervals, window_hashes, word_hashes, words_in

SCHEMA = "doc_id long, text string, removed string, kept int, block string, `a.b` string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows, window):
    first = {}
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        edges = np.flatnonzero(np.diff(np.array([False, *gone, False]))).reshape(-1, 2).tolist()
        out.append((i, len(w), edges, " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def found(spark, rows, window):
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    return sorted(
        [
            (r["doc_id"], r["n_words"], [[s["begin"], s["end"]] for s in r["removed"]], r["kept"])
            for r in repeated_intervals(docs, window=window).collect()
        ],
        key=str,
    )


def test_every_kind_of_row(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    again = "x " * 40
    rows = [
        (5, f"own words first {passage} and after"), (2, f"{passage}\v\tends here"), (9, passage), (9, passage),
        (9, f"another text {passage}"), (None, passage), (None, None), (1, None), (3, ""), (4, " \n\t"),
        (7, " ".join(passage.split()[:7])), (8, "short"), (10, again), (11, f"x {again} y"), (12, "zzz" * 9000),
        (13, "zzz" * 9000), (-4, f"é ü 日本 {again}"), (14, f"{passage} " * 3000), (6, f"{passage} " * 2),
    ]
    for window in (1, 8, 12, 50):
        assert found(spark, rows, window) == plain(rows, window)


def test_random_texts(spark):
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choice("abc") for _ in range(draw.randrange(60)))) for i in range(200)]
    draw.shuffle(rows)
    assert found(spark, rows, 5) == plain(rows, 5)


def test_one_passage_in_every_text(spark):
    hot = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own{i} " * (i % 7) + hot + f" tail{i}") for i in range(400)]
    got = found(spark, rows, 50)
    assert got == plain(rows, 50)
    assert sum(e - b for _, _, spans, _ in got for b, e in spans) == 60 * 399


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert repeated_intervals(docs).count() == 0
    assert repeated_intervals(docs).columns == ["doc_id", "n_words", "removed", "kept"]


def test_words_and_hashes():
    texts = [b"", b"a", b" a  bc\x0b", b"d", b"", b"x" * 100 + b" e"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    begins, ends, counts = words_in(data, offsets)
    cut = [data[b:e].tobytes() for b, e in zip(begins, ends, strict=True)]
    assert cut == [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert len(set(word_hashes(data, begins, ends).tolist())) == len(set(cut))
    codes = np.arange(1, 40, dtype=np.uint64) % np.uint64(5)
    hashes = window_hashes(codes, 5, 0x9E3779B97F4A7C15)
    assert all(h == hashes[i % 5] for i, h in enumerate(hashes))
    assert len(set(hashes.tolist())) == 5


def test_texts_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).write.parquet(path)
    out = repeated_intervals(spark.read.parquet(path), window=2)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 2
