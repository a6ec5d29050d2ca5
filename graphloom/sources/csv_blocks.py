"""Headered CSV whose values span lines, read by many tasks.

A line ends a record where the quotes up to it, from the start of the file, are even in number.
Whether they are is an associative state, so it is known per block of a file before the block is
cut into records:

1. each block's quotes are counted, and a running sum over block rows gives the state at its start;
2. the parts of records that blocks leave open at their edges, at most two a block, are put
   together by file and record;
3. all other records are cut out of their block where it is read.

Only block rows and edges are shuffled, whatever the size of a file.  Quotes inside a value are
doubled, and a value with a quote is quoted, as CSV writers do; lines end by LF or CR LF.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.constants import CSV_NULL_TOKENS
from graphloom.operators.validate import checked_broadcast
from graphloom.session import materialize

# What runs in tasks travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RECORD = "file string, row_order long, record string"
_EDGE = "file string, block long, opens boolean, row_order long, record string"


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.translate(value, '"', ""))


def _lines(spark: SparkSession, paths: str | Sequence[str], only_csv: bool) -> DataFrame:
    reader = spark.read.option("lineSep", "\n")
    if only_csv:
        reader = reader.option("pathGlobFilter", "*.csv")
    return reader.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )


def _with_states(lines: DataFrame) -> DataFrame:
    """``lines`` with ``inside``: whether their block starts inside a quoted value."""
    blocks = lines.groupBy("file", "block").agg((F.sum(_quotes(F.col("value"))) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = blocks.select(
        "file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")
    )
    states = materialize(states, "csv-blocks")
    small = checked_broadcast(states)
    joined = lines.join(small, ["file", "block"])
    if small is states:  # too many blocks to send around: lines move, and are put in order again
        joined = joined.repartition("file", "block").sortWithinPartitions("file", "block", "place")
    return joined.select("file", "block", "inside", "value")


class _Block:
    """The lines of a block as they come by."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block = file, block
        self.state = int(inside)
        self.continues = inside  # until the first record that started before this block has ended
        self.open: list[str] = []
        self.opened_at = 0
        self.n_lines = 0

    def take(self, values: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """(line and text of each record that starts and ends in the block; the end of the one before)."""
        lines = values.to_pylist()
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
        state = (self.state + np.cumsum(quotes)) & 1
        ends = np.flatnonzero(state == 0)
        first, self.n_lines = self.n_lines, self.n_lines + len(lines)
        self.state = int(state[-1])
        if not self.open:
            self.opened_at = first
        if not len(ends):
            self.open += lines
            return [], [], []
        at = [self.opened_at, *(first + ends[:-1] + 1).tolist()]
        begins = [0, *(ends[:-1] + 1).tolist()]
        records = [
            lines[a] if a == b else "\n".join(lines[a : b + 1]) for a, b in zip(begins, ends.tolist(), strict=True)
        ]
        records[0] = "\n".join([*self.open, records[0]])
        self.open, self.opened_at = lines[ends[-1] + 1 :], first + int(ends[-1]) + 1
        if self.continues:
            self.continues = False
            return at[1:], records[1:], records[:1]
        return at, records, []

    def order(self, line: int) -> int:
        # Lines take a byte at least, so this grows along the file.
        return 2 * self.block + line


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, pa.Array | None]]:
    """The runs of lines of one block, and None where the block is over."""
    here = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column(0).dictionary_encode()
        names = files.dictionary.to_pylist()
        which, starts = files.indices.to_numpy(), batch.column(1).to_numpy()
        change = np.flatnonzero((np.diff(which) != 0) | (np.diff(starts) != 0)) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
            file, block = names[which[a]], int(starts[a])
            if here is None or (here.file, here.block) != (file, block):
                if here:
                    yield here, None
                here = _Block(file, block, batch.column(2)[int(a)].as_py())
            yield here, batch.column(3).slice(a, b - a)
    if here:
        yield here, None


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, values in _blocks_of(batches):
        if values is None:
            continue
        at, records, _ = block.take(values)
        order = [block.order(i) for i in at]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block.file] * len(at), pa.string()), pa.array(order, pa.int64()), pa.array(records, pa.string())],
            names=["file", "row_order", "record"],
        )


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, values in _blocks_of(batches):
        if values is None:
            rows = [(not block.continues, "\n".join(block.open))] if block.open else []
        else:
            rows = [(False, text) for text in block.take(values)[2]]
        n, order = len(rows), block.order(block.opened_at)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block.file] * n, pa.string()), pa.array([block.block] * n, pa.int64()),
                pa.array([r[0] for r in rows], pa.bool_()), pa.array([order] * n, pa.int64()),
                pa.array([r[1] for r in rows], pa.string()),
            ],
            names=["file", "block", "opens", "row_order", "record"],
        )


def csv_records(spark: SparkSession, paths: str | Sequence[str], only_csv: bool = False) -> DataFrame:
    """``file, row_order, record``: the records of CSV files or folders, headers too, as they are
    written.  ``row_order`` grows along a file and is 0 for its first record.  Empty lines
    between records are left out; a quote that is never closed takes the rest of its file."""
    lines = _with_states(_lines(spark, paths, only_csv))
    whole = lines.mapInArrow(_whole_records, _RECORD)
    along = Window.partitionBy("file").orderBy("block", "opens")
    edges = lines.mapInArrow(_edges, _EDGE).withColumn("number", F.sum(F.col("opens").cast("int")).over(along))
    put_together = edges.groupBy("file", "number").agg(
        F.min(F.when(F.col("opens"), F.col("row_order"))).alias("row_order"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("block", "opens", "record"))), lambda e: e["record"]), "\n"
        ).alias("record"),
    )
    records = whole.unionByName(put_together.drop("number"))
    return records.withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record <> ''")


def with_nulls(df: DataFrame, names: Sequence[str], null_tokens: Sequence[str] = CSV_NULL_TOKENS) -> DataFrame:
    """Texts in ``null_tokens`` become null."""
    missing = [t for t in null_tokens if t]

    def kept(name: str) -> Column:
        value = F.col(f"`{name}`")
        is_missing = value.isin(*missing) if missing else F.lit(False)
        if "" in null_tokens:
            is_missing = is_missing | (value == "")
        return F.when(~is_missing, value)

    return df.withColumns({name: kept(name) for name in names})


def read_csv_blocks(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str | None = None,
    *,
    only_csv: bool = False,
    with_order: bool = False,
    null_tokens: Sequence[str] = CSV_NULL_TOKENS,
) -> DataFrame:
    """CSV files or folders put together by column name, large files by many tasks.

    Each file's first line names its columns; columns a file lacks are null.  All values are text,
    and null if in ``null_tokens``.  With a ``schema`` its columns are read, and no others.
    ``with_order`` adds ``source_file`` and ``row_order``, which grows along the file.  The driver
    holds the different headers, not the files.
    """
    records = csv_records(spark, paths, only_csv)
    headers = records.filter("row_order = 0").select(
        "file", F.regexp_replace("record", "^\ufeff", "").alias("header")
    )
    headers = materialize(headers, "csv-headers")
    texts = [r.header for r in headers.select("header").distinct().orderBy("header").collect()]
    of_text = {text: next(csv.reader(io.StringIO(text, newline=""))) for text in texts}
    columns = list(dict.fromkeys(name for names in of_text.values() for name in names))
    rows = records.filter("row_order > 0").join(checked_broadcast(headers), "file", "left")
    told = F.concat(F.lit("no header in the first line of "), "file")
    rows = rows.filter(F.when(F.col("header").isNull(), F.raise_error(told).cast("boolean")).otherwise(True))
    options = {"quote": '"', "escape": '"'}
    values: dict[str, Column] = {}
    parsed = {}
    for k, (text, names) in enumerate(of_text.items()):
        mine = F.col("header") == text
        fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        parsed[f"__{k}"] = F.when(mine, F.from_csv("record", fields.simpleString()[7:-1].replace(":", " "), options))
        for i, name in enumerate(names):
            value = F.col(f"__{k}")[f"c{i}"]
            values[name] = F.coalesce(values[name], value) if name in values else value
    # A name that a header repeats keeps its first column that has a value.
    out = rows.withColumns(parsed) if parsed else rows
    order = [F.col("file").alias("source_file"), F.col("row_order")] if with_order else []
    out = out.select(*[values[name].alias(name) for name in columns], *order)
    out = with_nulls(out, columns, null_tokens) if columns else out
    if schema is None:
        return out
    typed = [
        (F.col(f"`{f.name}`") if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in T.DataType.fromDDL(schema).fields
    ]
    return out.select(*typed, *(["source_file", "row_order"] if with_order else []))
