"""Incremental generation: every batch is written as soon as it is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.constants import BATCH_SIZE
from graphloom.operators.infer import Model
from graphloom.plans.generation import generate_graphs


def read_drops(
    spark: SparkSession,
    folder: str,
    schema,
    file_format: str = "json",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of the files that arrive in a folder: all that are new in one micro-batch, or
    at most ``files_per_batch``."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def generate_stream(
    sentences: DataFrame,
    load_model: Callable[[], Model],
    output_path: str,
    checkpoint_path: str,
    *,
    file_format: str = "parquet",
    batch_size: int = BATCH_SIZE,
    **options,
) -> StreamingQuery:
    """Answer all sentences that are there, appending each micro-batch, then stop.

    The file sink logs which batches are complete, so a restart neither repeats nor loses
    rows.  A later start with the same checkpoint goes on with the files new since then.
    """
    made = generate_graphs(sentences, load_model, batch_size=batch_size, **options)
    writer = made.writeStream.format(file_format).outputMode("append")
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    return (
        writer.option("path", output_path)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
