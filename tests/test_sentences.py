"""Sentence ends with learned abbreviations."""

from graphloom.functions.text import split_sentences
from graphloom.operators import sentences as S

SIMPLE = "The firm grew. It pays tax. We saw it. They left. All is well. Rain fell. He ran. She won."


def corpus(spark):
    rows = [(SIMPLE,)] * 30
    rows += [("See approx. ten of them (ca. nine) at No. 4. The cat sat.",)] * 12
    rows += [("It cost 3.14 in all, e.g. more than that. Then it rained.",)] * 12 + [(None,), ("",), (" \n",)]
    return spark.createDataFrame(rows, "text string")


def test_what_is_learned(spark):
    counts = S.abbreviation_counts(corpus(spark))
    found = {r["word"]: r for r in counts.collect()}
    assert (found["approx"]["n"], found["approx"]["n_dot"], found["approx"]["n_inside"]) == (12, 12, 12)
    assert found["ca"]["n_dot"] == 12 and found["tax"]["n_inside"] == 0 and found["the"]["score"] == 0
    learned = S.learned_abbreviations(counts)
    assert set(learned) == {"approx", "ca", "e.g"}
    assert S.learned_abbreviations(counts, most=1) == learned[:1]


def test_split(spark):
    texts = [
        "See approx. ten of them (ca. nine) now. The cat sat! Why? It cost 3.14 in all.", "e.g. this. Then that",
        "It was approx.\nTen came.", "...", "", None, "No end", "A. B. C.", "one\n\ntwo.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", S.split_by_abbreviations("t", ["approx", "ca", "e.g"]).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [
        ["See approx. ten of them (ca. nine) now.", "The cat sat!", "Why?", "It cost 3.14 in all."],
        ["e.g. this.", "Then that"], ["It was approx.", "Ten came."], ["..."], [], None, ["No end"],
        ["A.", "B.", "C."], ["one", "two."],
    ]
    plain = df.filter("i = 0").select(split_sentences("t").alias("s")).first()["s"]
    assert len(plain) == 7


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "text string")
    assert S.learned_abbreviations(S.abbreviation_counts(empty)) == []
    df = spark.createDataFrame([("A dog. A cat.",)], "t string")
    assert df.select(S.split_by_abbreviations("t", []).alias("s")).first()["s"] == ["A dog.", "A cat."]
