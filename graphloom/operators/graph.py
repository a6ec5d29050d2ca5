"""Graph operators: decode text once, then work on triples.

``decode_graphs`` is a narrow projection: no shuffle, no sort and no Python.  It adds a
nested ``triples`` array to every row; ``explode_triples`` turns it into the flat table
``(pos, depth, source, role, target, kind, inverted)`` that joins and aggregations use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import graph_text as G
from graphloom.functions.graph_write import writing_steps

INSTANCE = ":instance"
WIKI = ":wiki"
TRIPLE_FIELDS = ("pos", "depth", "source", "role", "target", "kind", "inverted")


def decode_graphs(
    df: DataFrame,
    graph_column: str,
    *,
    triples: str = "triples",
    decoded: str = "decoded",
    non_inverse_roles: Sequence[str] = (),
) -> DataFrame:
    """Add ``triples`` (null when the text is no well-formed graph) and the flag ``decoded``.

    A role ``:R-of`` that points at a variable is turned round and marked ``inverted``,
    unless it is listed in ``non_inverse_roles``.
    """
    text, marked, steps, walk = (
        f"__{triples}_{part}" for part in ("text", "marked", "steps", "walk")
    )
    out = df.withColumn(text, G.drop_alignments(G.drop_comments(graph_column)))
    out = out.withColumn(marked, G.mark_steps(text))
    legal = F.when(G.steps_legal(text, marked), F.col(marked))
    out = out.select(*df.columns, legal.alias(marked)).withColumn(steps, G.walk_steps(marked))
    out = out.withColumn(walk, G.walk_sources(steps))
    # The root alone hangs from nothing, so only the first depth is 0 and none is below; the last
    # one is what follows the last separator.
    one_root = F.expr(
        f"{walk}.depth = 0 AND array_position({walk}.depths, '0') = 1 "
        f"AND NOT exists(slice({walk}.depths, 2, size({walk}.depths) - 2), d -> d = '0' OR startswith(d, '-'))"
    )
    out = out.withColumn(decoded, F.coalesce(one_root, F.lit(False)))
    built = F.when(F.col(decoded), G.triples_of(steps, walk, non_inverse_roles))
    return pin_columns(
        out.select(*df.columns, decoded, built.alias(triples)), decoded, triples
    )


def pin_columns(df: DataFrame, *names: str) -> DataFrame:
    """Keep costly columns from being worked out again.

    The optimizer copies a column's expression into every filter above it.  Filters on
    the output of a generator stay above it, so a generator of exactly one row holds the
    named columns fixed; filters on all other columns still move down to the scan.
    """
    kept = [F.col(c) for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))


def explode_triples(df: DataFrame, triples: str = "triples") -> DataFrame:
    """One row per triple next to the other columns; undecodable rows give none.

    ``pos`` is the triple's place in text order.
    """
    kept = [F.col(c) for c in df.columns if c != triples]
    rows = df.select(*kept, F.posexplode(F.col(triples)).alias("pos", "__triple"))
    fields = [F.col("__triple")[name].alias(name) for name in TRIPLE_FIELDS[1:]]
    return rows.select(*kept, F.col("pos"), *fields)


def write_graphs(df: DataFrame, triples: str = "triples", text: str = "graph") -> DataFrame:
    """Add ``text``: the graph on one line, written from nested triples with ``pos``, ``source``,
    ``role``, ``target``, ``kind`` and ``inverted`` in order of ``pos``.

    The first node is the top.  A node opens where it did in its text if that edge is left, else by
    the first edge that reaches it, with its role turned where the edge points the other way;
    all other mentions are variables.  Decoding the text gives the same triples.  Null where no
    text does: no node, a variable declared twice, parts that nothing joins, or an edge that
    leaves an undeclared variable.
    """
    out = df
    for step in writing_steps(triples):
        out = out.withColumns({name: F.expr(sql) for name, sql in step.items()})
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    return out.select(*kept, F.inline(F.array(F.struct(F.col("__written").alias(text)))))


def encode_triples(rows: DataFrame, keys: Sequence[str], text: str = "graph") -> DataFrame:
    """``keys`` and ``text``: the graphs of a flat triples table such as :func:`explode_triples`
    gives, after any filter on its rows."""
    fields = ("pos", "source", "role", "target", "kind", "inverted")
    whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__rows"))
    return write_graphs(whole, "__rows", text).drop("__rows")


def without_wiki(triples: str) -> Column:
    """Nested triples without the role ``:wiki`` (exact name)."""
    return F.expr(f"filter({triples}, t -> t.role <> '{WIKI}')")


def remove_wiki_triples(triple_rows: DataFrame) -> DataFrame:
    """The flat form of :func:`without_wiki`."""
    return triple_rows.filter(F.col("role") != WIKI)


def node_concepts(triples: str) -> Column:
    """Concepts of a graph's nodes in text order."""
    return F.expr(f"filter({triples}, t -> t.kind = 'instance').target")


def top_concept(triples: str) -> Column:
    """Concept of the root node, which is the first triple."""
    return F.expr(f"get({triples}, 0).target")


def normalize_graphs(df: DataFrame, graph_column: str, remove_wiki: bool = True) -> DataFrame:
    """Rewrite a graph column in linear form, optionally without ``:wiki`` attributes."""
    return df.withColumn(
        graph_column, G.linearize(G.encode_graph(graph_column, remove_wiki=remove_wiki))
    )
