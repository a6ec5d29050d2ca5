"""The frame lexicon: one predicate per line, parts separated by two blanks.

    want-01  ARG0: wanter  ARG1: thing wanted
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import strip_unicode
from graphloom.operators.indexing import file_order, read_lines


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``predicate, labels, descriptions``, one row per predicate.

    A predicate's last line wins.  A part without ``': '`` is a label with an empty
    description.
    """
    return parse_lexicon(read_lines(spark, path), [file_order("file"), "file", "block", "place"])


def parse_lexicon(lines: DataFrame, order: list, line: str = "line") -> DataFrame:
    """The same for lines in any table, with the columns that put them in order."""
    parts = F.split(strip_unicode(line), "  ")
    arguments = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    rows = lines.select(
        F.get(parts, F.lit(0)).alias("predicate"),
        F.transform(arguments, lambda a: strip_unicode(F.split_part(a, F.lit(": "), F.lit(1)))).alias(
            "labels"
        ),
        F.transform(
            arguments,
            lambda a: F.when(
                F.instr(a, ": ") > 0, F.substring(a, F.instr(a, ": ") + 2, F.length(a))
            ).otherwise(""),
        ).alias("descriptions"),
        F.struct(*order).alias("at"),
    )
    last = F.max_by(F.struct("labels", "descriptions"), "at").alias("entry")
    return rows.groupBy("predicate").agg(last).select("predicate", "entry.*")


def lexicon_rows(lexicon: DataFrame) -> DataFrame:
    """Flat form: ``predicate, label, description``."""
    pairs = F.arrays_zip(F.col("labels").alias("label"), F.col("descriptions").alias("description"))
    return lexicon.select("predicate", F.inline(pairs))
