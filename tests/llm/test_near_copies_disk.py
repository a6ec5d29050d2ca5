"""What near copies leave on disk and send around as tables grow."""

import os
import time

import pytest

from graphloom.llm import ngram_join
from graphloom.llm.ngram_join import near_copies
from graphloom.session import materialize, shared_folder


def texts_around_a_passage(n):
    """Texts of one passage and a part that two have in common: all stay open, none link."""
    passage = [f"h{i}" for i in range(60)]
    rows = []
    for i in range(n):
        both = [f"b{i // 2}x{j}" for j in range(12)]
        own = [f"o{i}x{j}" for j in range(12)]
        rows.append((i, " ".join(passage + both + own)))
    return rows


def test_open_sets_meet_the_groups_of_their_rare_tokens_only(spark, monkeypatch):
    """A passage of all texts sends no set to all groups: meetings grow with the sets, not with their square."""
    monkeypatch.setattr(ngram_join, "PER_GROUP", 6)
    met = []

    def noted(df, label="table"):
        table = materialize(df, label)
        if label == "open-meetings":
            met.append(table.count())
        return table

    monkeypatch.setattr(ngram_join, "materialize", noted)
    rows = texts_around_a_passage(90)
    rows += [(1000 + i, text.replace("o", "p", 1)) for i, text in rows[:3]]  # copies but for one word
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "TURNS", 0)
    found = {r["doc_id"]: r["component_id"] for r in near_copies(docs).collect()}
    assert found == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert met and met[0] <= 2 * len(rows)


def test_long_tables_are_read_range_by_range(spark, monkeypatch):
    """The same groups as with one broadcast, and no table of tokens is left behind."""
    rows = texts_around_a_passage(40)
    rows += [(2000 - i, text + " more") for i, text in rows[:9]] + [(7, "a b c d"), (None, rows[0][1]), (5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, near_copies(docs).collect()), key=str)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 25)
    before = set(os.listdir(shared_folder(spark)))
    assert sorted(map(tuple, near_copies(docs).collect()), key=str) == want
    new = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_folder(spark))) - before}
    assert "numbered-texts" in new
    assert "from-texts" not in new or "open-prefixes" in new  # the one that open sets are read from


@pytest.mark.parametrize("kept", [None, "false"])
def test_shuffle_files_go_with_the_table_they_made(spark, kept):
    from graphloom.session import CLEANUP_CONF

    if kept:
        spark.conf.set(CLEANUP_CONF, kept)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    before = shuffled()
    made = spark.range(200_000).repartition(4, "id")
    table = materialize(made)
    for _ in range(50):  # files go in the background
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before
    assert table.count() == 200_000
    assert spark.conf.get(CLEANUP_CONF, None) in (None, "false")
    spark.conf.unset(CLEANUP_CONF)
