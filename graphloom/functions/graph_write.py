"""SQL fragments that write a graph from its triples.

Nodes are reached from the top in rounds: by the edge that opened a node in its text while that is
there, else by any edge that leads to it, against its direction if need be.  Texts are then
put together from the nodes reached last to the top.
"""

from __future__ import annotations

from graphloom.functions.arrays import bound, run_length, run_starts
from graphloom.functions.graph_match import positions


def _reached() -> str:
    """Per node ``struct<p, r>``: the edge that reaches it and in which round; null where none does."""
    new = """filter(transform(__edges, e -> CASE
        WHEN get(st, e.s) IS NOT NULL AND get(st, e.o) IS NULL THEN named_struct('v', e.o, 'i', e.i, 'open', e.open)
        WHEN get(st, e.s) IS NULL AND get(st, e.o) IS NOT NULL THEN named_struct('v', e.s, 'i', e.i, 'open', e.open)
        END), x -> x IS NOT NULL)"""
    first = """transform(st, (known, v) -> coalesce(known, get(transform(
        slice(filter(chosen, x -> x.v = v), 1, 1), x -> named_struct('p', x.i, 'r', round)), 0)))"""
    step = bound("chosen", "if(exists(new, x -> x.open), filter(new, x -> x.open), new)", first)
    step = bound("new", new, f"if(size(new) = 0, st, {step})")
    none = "transform(__names, (n, v) -> if(v = 0, named_struct('p', -1, 'r', 0), NULL))"
    # Most graphs are done after a few rounds.
    step = f"if(exists(st, x -> x IS NULL), {step}, st)"
    return f"aggregate(sequence(1, size(__names)), {none}, (st, round) -> {step})"


def _parts() -> str:
    """Per node what is written in it, in the order of the triples: role, and a value or a child."""

    def part(node: str, role: str, value: str, child: str = "-1") -> str:
        return f"named_struct('v', {node}, 'i', i, 'role', {role}, 'value', {value}, 'child', {child})"

    turned = "concat(t.role, '-of')"
    s, o = "get(__s, i)", "get(__o, i)"
    parts = f"""filter(transform(__triples, (t, i) -> CASE
        WHEN t.kind = 'instance' THEN NULL
        WHEN {o} < 0 THEN {part(s, "t.role", "t.target")}
        WHEN get(__reach, {o}).p = i THEN {part(s, "t.role", "''", o)}
        WHEN get(__reach, {s}).p = i THEN {part(o, turned, "''", s)}
        WHEN t.inverted THEN {part(o, turned, "t.source")}
        ELSE {part(s, "t.role", "t.target")} END), x -> x IS NOT NULL)"""
    ends = f"""sort_array(concat({parts}, transform(__names, (n, v) ->
        named_struct('v', v, 'i', -1, 'role', '', 'value', '', 'child', -1))))"""
    runs = f"transform(starts, (s, k) -> slice(ends, s + 2, {run_length('s', 'k', 'ends')} - 1))"
    return bound("ends", ends, bound("starts", run_starts("ends", ".v"), runs))


def writing_steps(triples: str) -> list[dict[str, str]]:
    """Columns to add one step after another to rows with the column ``triples``, an array of
    structs in text order; the last, ``__written``, is the graph's text.

    It is null where no text has these triples: without a node, with a variable declared twice, with
    nodes that no path joins, or with an edge that leaves an undeclared variable.
    """
    opened = """t.pos + 1 = coalesce(get(__triples, i + 1).pos, -1)
        AND get(__triples, i + 1).kind = 'instance'
        AND get(__triples, i + 1).source = if(t.inverted, t.source, t.target)"""
    text = """transform(__names, (n, v) -> if(get(__reach, v).r = round,
        concat('(', n, ' / ', get(concepts, v), aggregate(get(inside, v), '', (sum, x) ->
            concat(sum, ' ', x.role, ' ', if(x.child >= 0, get(texts, x.child), x.value))), ')'),
        get(texts, v)))"""
    usable = """size(__names) > 0 AND size(array_distinct(__names)) = size(__names)
        AND NOT exists(__s, x -> x < 0) AND NOT exists(__reach, x -> x IS NULL)"""
    node = "filter(__triples, t -> t.kind = 'instance')"
    written = f"""get(aggregate(sequence(array_max(__reach.r), 0, -1),
        transform(__names, n -> ''), (texts, round) -> {text}), 0)"""
    # Bound outside the lambdas: the optimizer puts a column that is read once in the place where it is
    # read, and there it would be worked out for each node in each round.
    written = bound("concepts", "__concepts", bound("inside", "__inside", written))
    return [
        {"__triples": triples},
        {"__names": f"{node}.source", "__concepts": f"{node}.target"},
        {
            "__s": positions("transform(__triples, t -> t.source)", "__names"),
            "__o": positions("transform(__triples, t -> if(t.kind = 'edge', t.target, NULL))", "__names"),
        },
        {
            "__edges": f"""filter(transform(__triples, (t, i) -> named_struct(
                'i', i, 's', get(__s, i), 'o', get(__o, i), 'open', {opened})),
                e -> e.s >= 0 AND e.o >= 0 AND get(__triples, e.i).kind = 'edge')"""
        },
        {"__reach": f"if(size(__names) > 0, {_reached()}, array())"},
        {"__usable": usable},
        {"__inside": f"if(__usable, {_parts()}, NULL)"},
        {"__written": f"if(__usable, {written}, NULL)"},
    ]
