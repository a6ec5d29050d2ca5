"""CSV, Parquet, JSON and text: readers and writers that keep graphs whole."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.constants import CSV_NULL_TOKENS
from graphloom.functions.text import pair_header
from graphloom.sources.csv_blocks import read_csv_blocks, with_nulls


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str | T.StructType | None = None,
    *,
    only_csv: bool = False,
    multi_line: bool = True,
    with_order: bool = False,
    null_tokens: Sequence[str] = CSV_NULL_TOKENS,
) -> DataFrame:
    """A headered CSV file or folder; quotes are doubled and values may span lines.

    Without a schema the header names the columns and all values are text.  Texts in
    ``null_tokens`` are read as null.  A file with values that span lines is read by one
    task; with ``multi_line=False`` large files are split, and ``read_csv_blocks`` splits both.  ``with_order`` adds
    ``source_file`` and ``row_order``, which grows along the file.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .option("enforceSchema", False)
    )
    if only_csv:
        reader = reader.option("pathGlobFilter", "*.csv")
    if schema is not None:
        reader = reader.schema(schema)
    paths = paths if isinstance(paths, str) else list(paths)
    df = reader.csv(paths)
    df = with_nulls(df, [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)], null_tokens)
    if with_order:
        df = df.select(
            "*",
            F.col("_metadata.file_path").alias("source_file"),
            F.monotonically_increasing_id().alias("row_order"),
        )
    return df


def read_translations(spark: SparkSession, folder: str) -> DataFrame:
    """``id, hu_sentence, source_file, row_order`` from the ``*.csv`` files of a folder, whatever
    the order of their columns and whatever others they have."""
    wanted = "id string, hu_sentence string"
    return read_csv_blocks(spark, folder, wanted, only_csv=True, with_order=True)


def _files_by_header(spark: SparkSession, paths, only_csv: bool) -> list[list[str]]:
    """The files with the same first line, for each such line.  The driver holds the names of the
    files, as the scan itself does."""
    reader = spark.read.option("pathGlobFilter", "*.csv") if only_csv else spark.read
    at = F.col("_metadata.file_block_start")
    lines = reader.text(paths).filter(at == 0).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), "value"
    )
    first = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    groups = first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return [[unquote(f) for f in row.files] for row in groups.orderBy("files").collect()]


def read_csv_union(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str | None = None,
    *,
    only_csv: bool = False,
    **options,
) -> DataFrame:
    """CSV files or folders put together by column name; columns a file lacks are null.

    With a ``schema`` its columns are read, and no others.  The plan has one scan for each
    different header, however many files there are.  ``options`` are those of ``read_csv``.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    frames = [read_csv(spark, files, **options) for files in _files_by_header(spark, paths, only_csv)]
    if not frames:  # no file, or empty ones: Spark's reader decides
        return read_csv(spark, paths, schema, only_csv=only_csv, **options)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    if schema is None:
        return out
    fields = T.DataType.fromDDL(schema).fields
    typed = [
        (F.col(f"`{f.name}`") if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ]
    order = ["source_file", "row_order"] if options.get("with_order") else []
    return out.select(*typed, *order)


def read_articles(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Article table without the columns nobody reads; the format prunes them at the scan."""
    unused = ("date_of_creation", "tags", "article", "title")
    return spark.read.format(file_format).load(path).drop(*unused)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; blanks at both ends, quotes and newlines survive a round trip.

    In a table of one column a null would be an empty line, which readers skip; there it is
    written as a quoted empty text, which is read as null again.
    """
    empty = ""
    if len(df.columns) == 1:
        name = df.columns[0]
        df = df.select(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(name))
        empty = '""'
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", empty)
        .option("nullValue", "")
        .csv(path)
    )


def append_batches(df: DataFrame, path: str, first: bool) -> None:
    """One batch of an incremental CSV sink: the first replaces, later ones append."""
    write_csv(df, path, "overwrite" if first else "append")


def pair_blocks(df: DataFrame, sentence: str = "hu_sentence", block: str = "block") -> DataFrame:
    """``value``: the model's block below a header with the other language's sentence."""
    return df.select(F.concat_ws("\n", pair_header(sentence), block).alias("value"))


def write_pair_blocks(
    df: DataFrame, path: str, sentence: str = "hu_sentence", block: str = "block",
    mode: str = "overwrite",
) -> None:
    """Blocks as text, each followed by one empty line."""
    pair_blocks(df, sentence, block).write.mode(mode).option("lineSep", "\n\n").text(path)
