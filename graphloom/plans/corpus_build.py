"""From annotated files and translations to one bilingual corpus, and on to training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.constants import ALL_LANGUAGES, HELD_OUT_OFFSET, INSTRUCTION_PROMPT
from graphloom.functions.text import render_prompt
from graphloom.operators.corpus import (
    CORPUS_COLUMNS,
    dedup_by_split,
    exact_sample,
    first_with_translation,
    languages_to_rows,
    shuffle_rows,
    split_views,
    union_with_synthetic,
)
from graphloom.operators.graph import normalize_graphs
from graphloom.operators.indexing import in_file_order, split_at
from graphloom.sources.blocks import read_split_folders
from graphloom.sources.csv_blocks import read_csv_blocks
from graphloom.sources.tables import read_translations


def build_corpus(
    records: DataFrame,
    translations: DataFrame,
    *,
    record_order: tuple[str, ...] = ("split_order", "source_file", "pos"),
    translation_order: tuple[str, ...] = ("hu_sentence",),
    remove_wiki: bool = True,
) -> DataFrame:
    """``id, sentence, amr_graph, split, lang``: one row per sentence over both languages.

    Graphs are rewritten last, on the rows that are left.
    """
    record_order = in_file_order(record_order)
    whole = first_with_translation(
        records, translations.select("id", "hu_sentence", *_named(translations, translation_order)),
        record_order, in_file_order(translation_order),
    )
    rows = languages_to_rows(whole)
    rows = dedup_by_split(rows, ["lang_order", *record_order])
    return normalize_graphs(rows, "amr_graph", remove_wiki).select(*CORPUS_COLUMNS)


def _named(df: DataFrame, order: tuple[str, ...]) -> list[str]:
    return [c for c in order if isinstance(c, str) and c in df.columns and c not in ("id", "hu_sentence")]


def load_corpus(spark: SparkSession, folder: str, remove_wiki: bool = True) -> DataFrame:
    """The corpus of a folder with ``training``, ``dev``, ``test`` and ``translation``."""
    folder = folder.rstrip("/")
    return build_corpus(
        read_split_folders(spark, folder),
        read_translations(spark, f"{folder}/translation"),
        translation_order=("source_file", "row_order"),
        remove_wiki=remove_wiki,
    )


def synthetic_rows(generated: DataFrame) -> DataFrame:
    """Generated rows under the corpus names."""
    return generated.withColumnRenamed("generated_amr", "amr_graph")


def training_table(
    corpus: DataFrame,
    synthetic: DataFrame | None,
    *,
    train_language: str = ALL_LANGUAGES,
    dev_language: str = ALL_LANGUAGES,
    use_gold: bool = True,
    gold_amount: int | None = None,
    synthetic_amount: int | None = None,
    synthetic_order: tuple[str, ...] = ("source_file", "row_order"),
    gold_keys: tuple[str, ...] = ("sentence", "lang"),
    seed: int | str = 0,
    held_out_offset: int = HELD_OUT_OFFSET,
) -> DataFrame:
    """Gold rows (shuffled, capped) and synthetic rows (the first of the file), shuffled
    together as ``train``, with the dev rows as ``validation`` in the column ``part``.
    ``synthetic_order`` is the order of the synthetic file, as ``read_csv(with_order=True)``
    gives it; it must tell rows apart.

    A synthetic amount beyond ``held_out_offset`` would train on held-out rows: an error.
    Without an amount the synthetic rows end at the offset.
    """
    if synthetic_amount is not None and synthetic_amount > held_out_offset:
        raise ValueError(
            f"{synthetic_amount} synthetic rows reach into the part held out from {held_out_offset}"
        )
    train, dev, _ = split_views(corpus, train_language, dev_language)
    gold = None
    if use_gold:
        gold = train
        if gold_amount is not None:
            gold = exact_sample(train, gold_amount, list(gold_keys), seed, at_most=True)
    if synthetic is not None:
        synthetic = synthetic_rows(synthetic)
        amount = held_out_offset if synthetic_amount is None else synthetic_amount
        synthetic = split_at(synthetic, in_file_order(synthetic_order), amount)[0]
        synthetic = synthetic.drop("source_file", "row_order")
    union = union_with_synthetic(gold, synthetic, corpus.sparkSession)
    # Generated sentences may repeat without bound.
    mixed = shuffle_rows(
        union.withColumn("part", F.lit("train")), list(gold_keys[:1]), seed, unique=synthetic is None
    )
    return mixed.unionByName(
        dev.withColumn("part", F.lit("validation")), allowMissingColumns=True
    )


def training_text(
    rows: DataFrame, eos: str = "", template: str = INSTRUCTION_PROMPT
) -> DataFrame:
    """Add ``text``: the filled prompt.  Rows without sentence or graph are left out."""
    return rows.dropna(subset=["sentence", "amr_graph"]).withColumn(
        "text", render_prompt("sentence", "amr_graph", template, eos)
    )


def evaluation_set(
    name: str,
    *,
    corpus: DataFrame | None = None,
    synthetic: DataFrame | None = None,
    order: tuple[str, ...] = ("source_file", "row_order"),
    language: str = "HU",
    held_out_offset: int = HELD_OUT_OFFSET,
) -> DataFrame:
    """``gold``: the corpus' test sentences of a language; ``held_out``: the tail of the
    synthetic table from ``held_out_offset`` on."""
    if name == "gold":
        return split_views(corpus, test_language=language)[2]
    if name == "held_out":
        return split_at(synthetic_rows(synthetic), in_file_order(order), held_out_offset)[1]
    raise ValueError(f"evaluation set is 'gold' or 'held_out', not {name!r}")


def read_generated(spark: SparkSession, path: str) -> DataFrame:
    """A generated CSV under the corpus names, with its row order."""
    return synthetic_rows(read_csv_blocks(spark, path, with_order=True))
