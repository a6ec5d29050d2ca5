"""A Merkle manifest of a table: leaves, a tree for each group of rows, one root over the groups.

Slot pivot: a parent's children are told apart by their slot, their position modulo the fanout.
Conditional aggregates over the parent spread the children's digests into one column per slot;
the columns together, hashed, are the parent, and without the own slot they are the siblings.

Positions come from a range sort and the counts of its partitions, never from one task.  Then
``TIER`` leaves that follow each other meet in one partition, where all levels up to their common
node are windows without a shuffle.  These nodes, a thousandth of the rows, go on the same way; a
leaf's path is its own tier's path and that of its node above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.validate import checked_broadcast
from graphloom.session import materialize

TIER = 1024  # at most so many leaves of one group in a piece of work
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the place in its lower 33 bits


def field_digest(*fields: Column) -> Column:
    """Hex sha256 of the fields one after another: ``-`` for null, else byte count, ``:``, value."""
    parts = []
    for field in fields:
        text = field.cast("string")
        told = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(told, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""
    return F.aggregate(
        path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256)
    )


def proof_digest(path: Column) -> Column:
    """Hex sha256 of the siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows(g, ...)`` with ``pos``, the place of a row in its group, and ``n``, the group's size.

    Rows that are equal in ``order`` are dealt by a number of their own, so that a great many
    of them do not meet in one task.
    """
    keys = ["g", *order, "tie"]
    sorted_rows = (
        rows.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("tie")
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id() % F.lit(1 << _LOCAL_BITS).cast("long"))
    )
    sorted_rows = materialize(sorted_rows, "manifest-leaves")
    # As many rows as partitions and groups together.
    runs = sorted_rows.groupBy("g", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("many"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "g", "part", (F.coalesce(F.sum("many").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("many").over(group).alias("n"),
    )
    runs = checked_broadcast(materialize(runs, "manifest-runs"))
    return sorted_rows.join(runs, ["g", "part"]).withColumn("pos", F.col("place") + F.col("shift")).drop(
        "part", "place", "shift"
    )


def _levels(fanout: int) -> int:
    """Levels of a tier: as many as ``TIER`` leaves fill."""
    levels = 1
    while fanout ** (levels + 1) <= TIER:
        levels += 1
    return levels


def _climbed(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes(g, pos, n, digest, ...)`` with ``top``, the node above at the end of the tier, and
    ``path``, the siblings up to there.  A group ends where one node is left."""
    levels = _levels(fanout)
    out = nodes.withColumn("piece", F.expr(f"pos div {fanout**levels}")).repartition("g", "piece")
    out = out.withColumn("top", F.col("digest")).withColumn(
        "path", F.array().cast("array<struct<left:string,right:string>>")
    )
    for level in range(levels):
        below = fanout**level
        slot = F.expr(f"(pos div {below}) % {fanout}")
        parent = Window.partitionBy("g", "piece", F.expr(f"pos div {below * fanout}"))
        slots = [f"slot{j}" for j in range(fanout)]
        for j, name in enumerate(slots):
            child = F.max(F.when(slot == j, F.col("top"))).over(parent)
            out = out.withColumn(name, F.coalesce(child, F.lit("")))
        left = F.concat(*[F.when(slot > j, F.col(name)).otherwise("") for j, name in enumerate(slots)])
        right = F.concat(*[F.when(slot < j, F.col(name)).otherwise("") for j, name in enumerate(slots)])
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        active = F.col("n") > below
        out = out.withColumns(
            {
                "path": F.when(active, F.concat("path", step)).otherwise(F.col("path")),
                "top": F.when(active, F.sha2(F.concat(*slots), 256)).otherwise(F.col("top")),
            }
        ).drop(*slots)
    return out


def _tree(nodes: DataFrame, most: int, fanout: int) -> DataFrame:
    """``nodes(g, pos, n, digest, ...)`` with ``top``, the root of the group, and the whole ``path``;
    ``most`` is the size of the largest group."""
    span = fanout ** _levels(fanout)
    here = _climbed(nodes, fanout)
    if most <= span:
        return here.drop("piece")
    above = here.filter(f"pos % {span} = 0").select(
        "g", F.col("piece").alias("pos"), F.ceil(F.col("n") / span).alias("n"), F.col("top").alias("digest")
    )
    above = _tree(materialize(above, "manifest-nodes"), -(-most // span), fanout)
    above = above.select("g", F.col("pos").alias("piece"), F.col("top").alias("root"), F.col("path").alias("rest"))
    joined = here.join(above, ["g", "piece"])
    return joined.withColumn("path", F.concat("path", "rest")).withColumn("top", F.col("root")).drop(
        "piece", "rest", "root"
    )


def build_manifest(
    leaves: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf", fanout: int = 2
) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``path`` (array of ``left, right``).

    Per value of ``group`` the leaves ascend by ``order`` and then by digest.  While more than
    one node is left, every ``fanout`` consecutive ones (the last run: fewer, even one) become
    the hex sha256 of their digests.  What is left is the group's subroot; the subroots, ordered
    by group (null first, bytewise), give the root likewise.

    Null is a group of its own, and a null in ``order`` comes first.  Rows equal in all of these
    have equal leaves, so it does not matter which comes first.  A single leaf is its subroot, a single
    subroot the root.  Other columns stay as they are, except that ones named like the new columns
    are replaced; the columns named here must exist.  An empty table gives no rows.
    """
    text = F.col(f"`{group}`").cast("string")
    # In front of every text but null, so that null is the first key.
    keyed = leaves.drop("subroot", "root", "path").select(
        F.coalesce(F.concat(F.lit("="), text), F.lit("")).alias("g"),
        F.col(f"`{leaf}`").alias("digest"),
        *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)],
        F.struct(*[F.col(f"`{c}`") for c in leaves.columns if c not in ("subroot", "root", "path")]).alias("row"),
    )
    placed = _placed(keyed, [*(f"o{i}" for i in range(len(order))), "digest"]).drop(
        *(f"o{i}" for i in range(len(order)))
    )
    most = placed.agg(F.max("n")).first()[0] or 0
    trees = materialize(_tree(placed, most, fanout), "manifest-trees")
    subroots = trees.filter("pos = 0").select(F.col("g").alias("key"), F.col("top").alias("digest"))
    subroots = _placed(subroots.withColumn("g", F.lit(0)), ["key"])
    groups = subroots.agg(F.max("n")).first()[0] or 0
    roots = _tree(subroots, groups, fanout).select(
        F.col("key").alias("g"), F.col("top").alias("root"), F.col("path").alias("rest")
    )
    return trees.join(checked_broadcast(materialize(roots, "manifest-roots")), "g").select(
        "row.*", F.col("top").alias("subroot"), "root", F.concat("path", "rest").alias("path")
    )
