"""Preparing sentences, calling a model on them, and scoring what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.constants import (
    ANSWER_HEADING,
    ARTICLE_DOMAIN,
    BATCH_SIZE,
    INSTRUCTION_PROMPT,
    SAMPLE_SEED,
    SAMPLE_SIZE,
)
from graphloom.functions.text import extract_answer, first_element, render_prompt, split_sentences
from graphloom.operators.corpus import exact_sample
from graphloom.operators.indexing import zip_text_files
from graphloom.operators.infer import Model, batch_infer
from graphloom.operators.score import evaluation_report, score_pairs
from graphloom.sources.tables import read_csv, write_csv, write_pair_blocks


def prepare_sentences(
    articles: DataFrame,
    *,
    domain: str = ARTICLE_DOMAIN,
    n: int = SAMPLE_SIZE,
    seed: int | str = SAMPLE_SEED,
    key: str = "uuid",
) -> DataFrame:
    """``uuid, url, sentence``: the first lead sentence of sampled articles of a domain.

    Sampling comes before sentence splitting, so only ``n`` leads are split.
    """
    chosen = articles.filter(F.col("domain") == domain)
    sampled = exact_sample(chosen, n, [key], seed)
    return sampled.select("uuid", "url", first_element(split_sentences("lead")).alias("sentence"))


def generate_graphs(
    sentences: DataFrame,
    load_model: Callable[[], Model],
    *,
    sentence: str = "sentence",
    output: str = "generated_amr",
    marker: str = ANSWER_HEADING,
    template: str = INSTRUCTION_PROMPT,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Prompt, model call and answer extraction; input columns stay next to the answer."""
    prompted = sentences.withColumn("__prompt", render_prompt(sentence, None, template))
    answered = batch_infer(prompted, load_model, "__prompt", output, batch_size=batch_size)
    return answered.withColumn(output, extract_answer(output, marker)).drop("__prompt")


def generate_file(
    spark: SparkSession, input_path: str, output_path: str, load_model: Callable[[], Model], **options
) -> None:
    """CSV with ``sentence`` in, CSV with ``sentence, generated_amr`` out."""
    made = generate_graphs(read_csv(spark, input_path), load_model, **options)
    write_csv(made.select("sentence", "generated_amr"), output_path)


def generate_pair_blocks(
    spark: SparkSession,
    english_path: str,
    hungarian_path: str,
    output_path: str,
    load_model: Callable[[], Model],
    batch_size: int = BATCH_SIZE,
) -> None:
    """Parallel files in; the model's blocks for the English side, each below a header
    with the Hungarian sentence, out."""
    pairs = zip_text_files(spark, english_path, hungarian_path, "sentence", "hu_sentence")
    # Lines keep their order: rows are spread by ranges of line numbers.  The ranges are drawn from
    # the input, so that the model, which keeps the order of rows, sees each row once.
    ordered = pairs.repartitionByRange("line_no").sortWithinPartitions("line_no")
    blocks = batch_infer(ordered, load_model, "sentence", "block", batch_size=batch_size)
    write_pair_blocks(blocks, output_path)


def evaluate_file(
    spark: SparkSession, data_path: str, ref_column: str, pred_column: str, output_path: str, **options
) -> DataFrame:
    """Score a CSV of graph pairs, write the scored rows and return the report."""
    scored = score_pairs(read_csv(spark, data_path), ref_column, pred_column, **options)
    write_csv(scored, output_path)
    written = read_csv(spark, output_path)
    numbers = {c: F.col(c).cast("double") for c in scored.columns if c.startswith("smatchpp_")}
    return evaluation_report(
        written.withColumns({**numbers, "parsable": F.col("parsable").cast("boolean")})
    )
