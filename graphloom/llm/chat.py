"""Chat formatting by Spark expressions alone: tool calls linked to their results.

Calls and results meet in a hash join on (conversation, identifier).  A call that mentions the
result of another call comes after it; calls are ordered by that depth, then by place.  Arguments are
held against the tool's schema.  A conversation becomes one line of canonical JSON: keys
in code point order, no blanks, text as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

#: JSON types that schemas name, by how Spark names a variant's type.
_KINDS = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "DECIMAL|DOUBLE|FLOAT|BIGINT",
    "boolean": "BOOLEAN",
    "object": "OBJECT",
    "array": "ARRAY",
}


def canonical(json: Column) -> Column:
    """Canonical form of a JSON text; null if it is none.  Objects keep one value per key."""
    return F.to_json(F.try_parse_json(json))


def _typed(value: Column, kind: Column) -> Column:
    """Does a variant have the JSON type that a schema names?"""
    have = F.upper(F.schema_of_variant(value))
    ok = F.lit(False)
    for name, pattern in _KINDS.items():
        ok = ok | ((kind == name) & have.rlike(f"^({pattern})"))
    return F.coalesce(ok, F.lit(False))


def order_calls(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, depth`` of ``calls(conv_id, call_id, needs array<string>)``.

    Depth 0 needs no other call of the conversation; each round places the calls whose needs all
    have a depth.  Calls in a cycle, or behind one, get depth -1.
    """
    calls = calls.select("conv_id", "call_id", "needs").groupBy("conv_id", "call_id").agg(
        F.array_distinct(F.flatten(F.collect_list("needs"))).alias("needs")
    )
    edges = calls.select("conv_id", "call_id", F.explode("needs").alias("need"))
    known = calls.select("conv_id", F.col("call_id").alias("need"))
    edges = materialize(edges.join(known, ["conv_id", "need"], "left_semi"), "needs")
    behind = edges.select("conv_id", "call_id").distinct()
    placed = calls.join(behind, ["conv_id", "call_id"], "left_anti").select(
        "conv_id", "call_id", F.lit(0).alias("depth")
    )
    waiting = edges
    turn = 0
    while not waiting.isEmpty():
        turn += 1
        done = placed.select("conv_id", F.col("call_id").alias("need"))
        open_edges = waiting.join(done, ["conv_id", "need"], "left_anti")
        ready = waiting.select("conv_id", "call_id").distinct().join(
            open_edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti"
        )
        ready = materialize(ready.withColumn("depth", F.lit(turn)), "ready")
        if ready.isEmpty():
            rest = waiting.select("conv_id", "call_id").distinct().withColumn("depth", F.lit(-1))
            return placed.unionByName(rest)
        placed = materialize(placed.unionByName(ready), "placed")
        waiting = materialize(waiting.join(ready, ["conv_id", "call_id"], "left_anti"), "waiting")
    return placed


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Each call with its result, depth and verdict.

    ``calls(conv_id, turn, call_id, name, arguments)``, ``results(conv_id, turn, call_id,
    content)``, ``schemas(name, fields map<string,string>, required array<string>)``.  A call is
    ``valid`` if its arguments are a JSON object with all required keys, no unknown key and the
    named types.  An argument ``{"$call": id}`` needs that call.  Of several results the one of
    the first turn behind the call counts; results without a call, and null identifiers, link
    with nothing.  Calls that repeat an identifier share its result.
    """
    parsed = calls.withColumn("v", F.try_parse_json("arguments"))
    # The identifiers that stand as {"$call": "..."} anywhere in the canonical text.
    parsed = parsed.withColumn("canonical", F.to_json("v")).withColumn(
        "needs", F.regexp_extract_all("canonical", F.lit(r'\{"\$call":"([^"]*)"\}'), F.lit(1))
    )
    parsed = parsed.withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
    depths = order_calls(parsed.filter("call_id IS NOT NULL"))
    behind = parsed.select("conv_id", "call_id", F.col("turn").alias("call_turn")).distinct()
    replies = results.join(behind, ["conv_id", "call_id"]).filter("turn > call_turn")
    first = replies.groupBy("conv_id", "call_id", F.col("call_turn").alias("turn")).agg(
        F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("result")
    )
    full = parsed.join(schemas, "name", "left").join(first, ["conv_id", "call_id", "turn"], "left")
    full = full.join(depths, ["conv_id", "call_id"], "left")
    given = F.from_json("arguments", "map<string,variant>")
    required = F.coalesce("required", F.array().cast("array<string>"))
    valid = (
        F.col("canonical").startswith("{")
        & F.col("fields").isNotNull()
        & (F.size(F.array_except(required, F.map_keys(given))) == 0)
        & F.forall(F.map_entries(given), lambda e: _typed(e["value"], F.col("fields")[e["key"]]))
    )
    return full.select(
        "conv_id", "turn", "call_id", "name", "canonical", "depth", "result",
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def format_turns(turns: DataFrame, linked: DataFrame) -> DataFrame:
    """``conv_id, turn, role, call_id, depth, valid, linked, line``: each turn as a line of
    canonical JSON, with the call it makes.

    One line per turn, so a conversation of any length is never gathered.  Null text, role or
    numbers are left out of a line.  Turns without a call have null ``call_id, depth`` and false
    ``valid, linked``.  A turn repeated n times gives n lines for each of its calls.
    """
    full = turns.select("conv_id", "turn", "role", "text").join(
        linked.withColumn("linked", F.col("result").isNotNull()), ["conv_id", "turn"], "left"
    )
    call = F.struct(
        F.try_parse_json("canonical").alias("arguments"), "depth",
        F.col("call_id").alias("id"), "name",
        F.col("result.result_turn").alias("result_turn"), "valid",
    )
    line = F.struct(
        F.col("text").alias("content"), "role",
        F.when(F.col("call_id").isNotNull(), call).alias("tool_call"), "turn",
    )
    return full.select(
        "conv_id", "turn", "role", "call_id", "depth",
        F.coalesce("valid", F.lit(False)).alias("valid"),
        F.coalesce("linked", F.lit(False)).alias("linked"),
        F.to_json(line).alias("line"),
    )
