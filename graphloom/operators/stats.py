"""Corpus statistics on decoded graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import as_column
from graphloom.operators.graph import node_concepts, top_concept


def value_counts(df: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """Rows per value, most frequent first, nulls left out.

    The count is combined before the shuffle, so a hot value costs one row per task.
    """
    counted = df.select(as_column(value).alias(name)).filter(F.col(name).isNotNull())
    return counted.groupBy(name).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), name)


def top_concept_counts(decoded: DataFrame, triples: str = "triples") -> DataFrame:
    """How often each concept is a graph's root."""
    return value_counts(decoded, top_concept(triples), "concept")


def concept_counts(decoded: DataFrame, triples: str = "triples") -> DataFrame:
    """How often each concept occurs over all nodes of all graphs."""
    # An outer generator, because for an inner one the optimizer works the array out in a
    # filter too; the nulls it adds are not counted.
    nodes = decoded.select(F.explode_outer(node_concepts(triples)).alias("concept"))
    return value_counts(nodes, "concept", "concept")


def inspect_rows(df: DataFrame, order: list[str], n: int = 1000) -> DataFrame:
    """The first ``n`` rows for reading; a top-n per task, never a full sort."""
    return df.orderBy(*order).limit(n)
