"""Validation of graph text as flag columns.

All checks but the frame check are narrow projections on one decoded column; the frame
check is a join of the graphs' core roles with the frame lexicon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import graph_text as G
from graphloom.functions.arrays import bound, per_run
from graphloom.functions.text import newlines_to_blanks
from graphloom.operators.graph import decode_graphs
from graphloom.session import materialize

# The order of the checks in the full chain.
CHECKS = ("parentheses", "decodes", "parses", "frames", "and_or")


def variables_unique(triples: str) -> Column:
    """True when no variable is declared twice."""
    declared = f"filter({triples}, t -> t.kind = 'instance').source"
    return F.expr(f"size({declared}) = size(array_distinct({declared}))")


def wiki_removable(graph: Column | str) -> Column:
    """False when a ``:wiki`` role opens a node, which removal would cut off."""
    return ~G.outside_quotes(graph).rlike(r'(?<![^\s()"]):wiki\s*\(')


def connectives_numbered(triples: str) -> Column:
    """The ``and``/``or`` check on decoded triples.

    Nodes count in text order and the first one that is not in order decides: a single
    ``:op2`` passes the whole graph, fewer than two ops or ops other than 1..n fail it.
    An ``:op`` role without a number fails.
    """
    # The and/or nodes and all ops, grouped by variable; ``at`` is the node's place in the text.
    entries = f"""filter(transform({triples}, (t, i) -> named_struct('v', t.source, 'i', i,
        'opens', t.kind = 'instance' AND t.target IN ('and', 'or'), 'role', t.role)),
        x -> x.opens OR startswith(x.role, ':op'))"""
    verdict = """CASE
        WHEN exists(ops, o -> o IS NULL) THEN 'fail'
        WHEN ops = array(2) THEN 'pass'
        WHEN size(ops) < 2 THEN 'fail'
        WHEN ops <> sequence(1, size(ops)) THEN 'fail'
        ELSE 'next' END"""
    ops = """transform(filter(run, x -> startswith(x.role, ':op')),
        x -> try_cast(substring(x.role, 4) AS int))"""
    judged = bound("ops", ops, f"named_struct('at', at, 'verdict', {verdict})")
    judged = bound("at", "get(filter(run, x -> x.opens).i, 0)", f"if(at IS NULL, NULL, {judged})")
    verdicts = f"array_sort(array_compact({per_run(entries, 'v', judged)}))"
    return F.expr(
        f"coalesce(get(filter({verdicts}, j -> j.verdict <> 'next').verdict, 0), 'pass') = 'pass'"
    )


def flag_valid(df: DataFrame, graph_column: str, flag: str = "valid") -> DataFrame:
    """Add the basic validity flag: parentheses, decodable, encodable without wiki, and
    no variable declared twice.  Null and broken graphs are false, never an error."""
    text = newlines_to_blanks(graph_column)
    checked = decode_graphs(
        df.withColumn("__text", text), "__text", triples="__triples", decoded="__decoded"
    )
    ok = (
        F.col("__decoded")
        & wiki_removable("__text")
        & variables_unique("__triples")
    )
    return checked.withColumn(flag, F.coalesce(ok, F.lit(False))).drop(
        "__text", "__triples", "__decoded"
    )


def filter_valid(df: DataFrame, graph_column: str, observation=None) -> DataFrame:
    """Keep valid graphs.  A ``pyspark.sql.Observation`` receives ``rows`` and ``dropped``
    in the same pass, so counting costs no job of its own."""
    flagged = flag_valid(df, graph_column, flag="__valid")
    if observation is not None:
        flagged = flagged.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~F.col("__valid")).alias("dropped"),
        )
    return flagged.filter("__valid").drop("__valid")


def _core_role_pairs(triples: str) -> Column:
    """The distinct ``predicate, label`` of a graph: ``:ARG`` edges with the concepts they leave."""
    entries = f"""transform(
        filter({triples}, t -> t.kind = 'instance' OR t.kind = 'edge' AND startswith(t.role, ':ARG')),
        t -> named_struct('v', t.source, 'label', if(t.kind = 'edge', substring(t.role, 2), NULL),
                          'predicate', if(t.kind = 'edge', NULL, t.target)))"""
    own = """flatten(transform(array_distinct(array_compact(run.label)), label ->
        transform(concepts, c -> named_struct('predicate', c, 'label', label))))"""
    own = bound("concepts", "array_compact(run.predicate)", own)
    return F.expr(f"array_distinct(flatten({per_run(entries, 'v', own)}))")


def core_roles(decoded: DataFrame, keys: Sequence[str], triples: str = "triples") -> DataFrame:
    """``keys, predicate, label``: every ``:ARG`` edge with the concept it leaves."""
    pairs = _core_role_pairs(triples)
    # The pairs of a graph repeat often; distinct ones are enough for a verdict.  An outer
    # generator, because for an inner one the optimizer works the pairs out in a filter too.
    rows = decoded.select(*keys, F.inline_outer(pairs))
    return rows.filter(F.col("predicate").isNotNull())


def checked_broadcast(
    df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20
) -> DataFrame:
    """Broadcast ``df`` when it is small by rows and by bytes, else leave the join to the
    optimizer (a shuffle join whose hot keys adaptive execution splits)."""
    size = (
        df.limit(max_rows + 1)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes"),
        )
        .first()
    )
    return F.broadcast(df) if size.rows <= max_rows and size.bytes <= max_bytes else df


def frame_violations(
    roles: DataFrame, lexicon: DataFrame, keys: Sequence[str], max_lexicon_rows: int = 100_000
) -> DataFrame:
    """Keys of graphs with a core role that the entry of a known predicate lacks.

    ``lexicon`` has one row per predicate with ``labels array<string>``.
    """
    entries = checked_broadcast(lexicon.select("predicate", "labels"), max_lexicon_rows)
    return (
        roles.join(entries, "predicate")
        .filter(~F.array_contains("labels", F.col("label")))
        .select(*keys)
        .distinct()
    )


def validate_graphs(
    df: DataFrame,
    graph_column: str,
    keys: Sequence[str],
    lexicon: DataFrame | None = None,
    max_lexicon_rows: int = 100_000,
) -> DataFrame:
    """Add a flag per check, ``valid`` and ``first_failure`` (null when all pass).

    Rows are judged each for itself, whatever their ``keys``.  Without a lexicon every predicate is
    unknown and the frame check passes for decodable graphs; with one the rows are written once.
    """
    prepared = decode_graphs(df.withColumn("__text", newlines_to_blanks(graph_column)), "__text")
    flagged = (
        prepared.withColumn("parentheses", G.parens_balanced("__text"))
        .withColumn("decodes", F.col("decoded"))
        .withColumn("parses", F.col("decoded") & variables_unique("triples"))
        .withColumn("and_or", F.col("decoded") & connectives_numbered("triples"))
    )
    if lexicon is None:
        flagged = flagged.withColumn("frames", F.col("decoded"))
    else:
        # Decoded once: verdicts and pairs are written, and the pairs that fail come back by row.
        told = flagged.withColumns({"__pairs": _core_role_pairs("triples"), "__row": F.monotonically_increasing_id()})
        told = materialize(told.drop("triples", "__text"), "verdicts")
        roles = told.select("__row", F.inline("__pairs"))
        bad = frame_violations(roles, lexicon, ["__row"], max_lexicon_rows).withColumn("__bad", F.lit(True))
        flagged = told.drop("__pairs").join(bad, "__row", "left")
        flagged = flagged.withColumn("frames", F.col("decoded") & F.col("__bad").isNull())
    flagged = flagged.select(
        *df.columns, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in CHECKS]
    )
    first = F.lit(None).cast("string")
    for check in reversed(CHECKS):
        first = F.when(~F.col(check), check).otherwise(first)
    flagged = flagged.withColumn("first_failure", first)
    return flagged.withColumn("valid", F.col("first_failure").isNull())
