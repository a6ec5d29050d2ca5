"""Row positions without a single-task window.

Positions are a partition's offset plus a place inside the partition.  Rows are spread by
range over the order columns, so a sort never meets in one task, and written once, so that
offsets and places stay true when a task runs again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import as_column, strip_unicode
from graphloom.operators.validate import checked_broadcast
from graphloom.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the place in its lower 33 bits


def with_row_index(df: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2, … in the order given.

    ``order`` must tell any two rows apart; add a tie-breaking column where it does not.
    """
    order = [as_column(c) for c in order]
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn(
            "__place", F.monotonically_increasing_id() % F.lit(1 << _LOCAL_BITS).cast("long")
        )
    )
    placed = materialize(placed, "indexed")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = _prefix_sums(sizes, ["__part"], "__n", "__before")
    # One row per partition of the table above: bounded by the number of its partitions.
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__before") + F.col("__place"))
        .drop("__part", "__place", "__before")
    )


def _prefix_sums(sizes: DataFrame, order: Sequence[str], size: str, out: str) -> DataFrame:
    """Sum of all earlier sizes.  ``sizes`` has one row per partition or file block, so the
    one window over all of them is short whatever the number of data rows."""
    before = Window.partitionBy(F.lit(0)).orderBy(*order)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0))).drop(size)


def file_order(path: Column | str) -> Column:
    """A text that sorts like ``path``, but with numbers by value: ``part-99999`` comes before
    ``part-100000``."""
    padded = F.regexp_replace(as_column(path), r"(\d+)", "0" * 20 + "$1")
    return F.regexp_replace(padded, r"0*(\d{20,})", "$1")


def in_file_order(order: Sequence[Column | str]) -> list[Column | str]:
    """``order`` with file names by the numbers in them."""
    named = [isinstance(c, str) and c == "source_file" for c in order]
    return [x for c, path in zip(order, named, strict=True) for x in ([file_order(c), c] if path else [c])]


def read_lines(spark, paths) -> DataFrame:
    """Text lines with ``file, block, place``: a line's file, the start of the block it was
    read from, and a number that grows inside the block.  Large files are read in blocks."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
    )


def read_numbered_lines(spark, path, name: str = "line_no") -> DataFrame:
    """``file, line_no, line``: lines numbered from 0 over all files in name order, numbers in
    names by value.

    Only line counts per block meet before the join.  They are written, and broadcast after a
    check of their size, so no line is sorted or shuffled to be numbered.
    """
    lines = read_lines(spark, path)
    blocks = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("__n"), F.min("place").alias("__first")
    )
    offsets = _prefix_sums(blocks, [file_order("file"), "file", "block"], "__n", "__before")
    offsets = checked_broadcast(materialize(offsets, "line-offsets"))
    return lines.join(offsets, ["file", "block"]).select(
        "file", (F.col("__before") + F.col("place") - F.col("__first")).alias(name), "line"
    )


_CUTS = 32  # keys that split what is left in one round
_SORTED = 50_000  # so many keys are sorted to find one


def _key(order: Sequence[Column | str]) -> Column:
    return F.struct(*[as_column(c).alias(f"k{i}") for i, c in enumerate(order)])


def _literal(key: Row, like: T.StructType) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, like.fields)])


def _range_of(key: Column, cuts: list[Column]) -> Column:
    """Number of the range that holds ``key``, by a search that halves the cuts."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key <= cuts[middle], within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(cuts))


def nth_key(df: DataFrame, order: Sequence[Column | str], n: int) -> Column | None:
    """The key, as a struct of the ``order`` columns, of the ``n``-th row in their order, counted from 1;
    null sorts first.  None if there are fewer rows.

    Only the order columns are read, and no row is moved: each round counts the rows between some
    keys drawn by hashes, and the next one looks at the one range that holds the row.
    """
    keys = df.select(_key(order).alias("key"))
    like = keys.schema["key"].dataType
    left, before = keys, 0
    total = keys.count()
    if n < 1 or n > total:
        return None
    while total > _SORTED:
        # Each hash draws one of the different keys, however often one of them repeats; the
        # smallest is a cut too, so that every round leaves some rows behind.
        drawn = [F.min_by("key", F.xxhash64("key", F.lit(j))) for j in range(_CUTS - 1)]
        found = left.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.array(*drawn).alias("drawn"))
        cuts_of = F.array_sort(F.array_distinct(F.array_append("drawn", F.col("low"))))
        told = found.select("low", (F.col("low") == F.col("high")).alias("one"), cuts_of.alias("cuts")).first()
        if told.one:
            return _literal(told.low, like)
        cuts = [_literal(key, like) for key in told.cuts]
        counts = left.groupBy(_range_of(F.col("key"), cuts).alias("at")).count().collect()
        sizes = {row["at"]: row["count"] for row in counts}
        at = 0
        while before + sizes.get(at, 0) < n:
            before += sizes.get(at, 0)
            at += 1
        total = sizes[at]
        if at > 0:
            left = left.filter(F.col("key") > cuts[at - 1])
        if at < len(cuts):
            left = left.filter(F.col("key") <= cuts[at])
    last = left.orderBy("key").limit(n - before).orderBy(F.desc("key")).first()
    return _literal(last.key, like)


def split_at(df: DataFrame, order: Sequence[Column | str], n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows in ``order``, and all others: two filters, for which no row is sorted,
    moved or written.  ``order`` must tell the ``n``-th row from the next."""
    if n <= 0:
        return df.limit(0), df
    key = nth_key(df, order, n)
    if key is None:
        return df, df.limit(0)
    mine = _key(order)
    head, tail = df.filter(mine <= key), df.filter(mine > key)
    if head.count() != n:
        raise ValueError(f"the order does not tell row {n} from the next")
    return head, tail


def positional_split(
    indexed: DataFrame, index: str = "idx", name: str = "split",
    bounds: tuple[float, float] = (0.8, 0.9),
) -> DataFrame:
    """Tag rows training / dev / test by position; bounds are cut to whole rows."""
    total = indexed.count()
    first, second = (int(total * b) for b in bounds)
    split = (
        F.when(F.col(index) < first, "training").when(F.col(index) < second, "dev").otherwise("test")
    )
    return indexed.withColumn(name, split)


def batch_number(index: Column | str, batch_size: int) -> Column:
    """Number of the batch a position falls into."""
    return F.floor(as_column(index) / batch_size)


def zip_rows(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """Pair the i-th row of one side with the i-th of the other; raise on unequal counts."""
    a = with_row_index(left, left_order, "idx")
    b = with_row_index(right, right_order, "idx")
    require_equal_counts(a, b)
    return a.join(b, "idx")


def require_equal_counts(left: DataFrame, right: DataFrame) -> None:
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"sides differ in length: {n} rows and {m} rows")


def zip_text_files(spark, left_path: str, right_path: str, left: str, right: str) -> DataFrame:
    """Pairs of lines of two line-aligned files, stripped: ``line_no, left, right``."""
    a = read_numbered_lines(spark, left_path).select(
        "line_no", strip_unicode("line").alias(left)
    )
    b = read_numbered_lines(spark, right_path).select(
        "line_no", strip_unicode("line").alias(right)
    )
    require_equal_counts(a, b)
    return a.join(b, "line_no")
