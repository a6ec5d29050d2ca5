"""Appending sinks that bear a batch that is written again.

Below a sink's path each batch has a folder of its own, ``data/run=<run>/batch=<n>``, which a repeat
overwrites, and an entry in ``ledger/`` that is written when the batch is complete.  Readers
take the batches of the ledger only, so one that stopped in the middle is not seen until it has
been written again.  A run is one stream, named by its checkpoint: another stream adds to the same
sink without touching what is there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.blocks import read_graph_blocks
from graphloom.sources.csv_blocks import read_csv_blocks
from graphloom.sources.tables import write_csv, write_pair_blocks

Writer = Callable[[DataFrame, str], None]
_LEDGER = "run string, batch long"


def run_of(checkpoint_path: str) -> str:
    return hashlib.md5(checkpoint_path.encode()).hexdigest()[:12]


def complete_batches(spark: SparkSession, path: str) -> DataFrame:
    """``run, batch`` of the ledger, which has one row per complete batch."""
    try:
        return spark.read.schema(_LEDGER).json(f"{path}/ledger/*").distinct()
    except AnalysisException:  # nothing is complete yet
        return spark.createDataFrame([], _LEDGER)


def write_batch(df: DataFrame, path: str, number: int, write: Writer = write_csv, run: str = "0") -> bool:
    """Write one batch and enter it in the ledger; a batch that is complete is left as it is.

    Returns whether the batch was written.  ``write(df, folder)`` overwrites its folder.
    """
    spark = df.sparkSession
    there = complete_batches(spark, path).filter((F.col("run") == run) & (F.col("batch") == number))
    if not there.isEmpty():
        return False
    write(df, f"{path}/data/run={run}/batch={number}")
    entry = spark.createDataFrame([(run, number)], _LEDGER).coalesce(1)
    entry.write.mode("overwrite").json(f"{path}/ledger/{run}-{number}")
    return True


def write_stream(
    stream: DataFrame, path: str, checkpoint_path: str, write: Writer = write_csv
) -> StreamingQuery:
    """Append what is there of a stream, batch by batch, then stop.  A start with the same checkpoint
    goes on behind the last complete batch; one that had stopped in the middle is repeated."""
    run = run_of(checkpoint_path)

    def append(batch: DataFrame, number: int) -> None:
        write_batch(batch, path, number, write, run)

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def append_pair_blocks(stream: DataFrame, path: str, checkpoint_path: str) -> StreamingQuery:
    """A stream of ``hu_sentence, block`` as pair blocks."""
    return write_stream(stream, path, checkpoint_path, write_pair_blocks)


def _complete(rows: DataFrame, path: str) -> DataFrame:
    """The rows of complete batches, by the folder of their ``source_file``."""
    spark = rows.sparkSession
    found = r"/run=([^/]+)/batch=(\d+)/"
    named = rows.withColumns(
        {
            "__run": F.regexp_extract("source_file", found, 1),
            "__batch": F.regexp_extract("source_file", found, 2).cast("long"),
        }
    )
    ledger = complete_batches(spark, path).toDF("__run", "__batch")
    return named.join(ledger, ["__run", "__batch"], "left_semi").select(rows.columns)


def read_csv_batches(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of all complete batches of a CSV sink."""
    rows = read_csv_blocks(spark, f"{path}/data/*/*", schema, with_order=True)
    return _complete(rows, path).drop("source_file", "row_order")


def read_pair_batches(spark: SparkSession, path: str) -> DataFrame:
    """The records of all complete batches of a pair block sink."""
    return _complete(read_graph_blocks(spark, f"{path}/data/*/*"), path)
