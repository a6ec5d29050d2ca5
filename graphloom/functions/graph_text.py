"""Column expressions on bracketed graph text.  No Python runs per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import as_column, strip_unicode

# A quote toggles on every '"'; an unclosed one swallows the rest of the text.
_QUOTED_OR_TAIL = r'"[^"]*("|$)'
_QUOTED = r'"[^"]*"'


def outside_quotes(graph: Column | str) -> Column:
    """The text with every quoted span removed."""
    return F.regexp_replace(as_column(graph), _QUOTED_OR_TAIL, "")


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.translate(text, char, ""))


def unmatched_open_parens(graph: Column | str) -> Column:
    """Opening minus closing parentheses outside quotes, at least 0."""
    bare = outside_quotes(graph)
    return F.greatest(_occurrences(bare, "(") - _occurrences(bare, ")"), F.lit(0))


def close_open_parens(graph: Column | str) -> Column:
    """Repair a truncated graph: append ``' )'`` for every unmatched ``(``."""
    graph = as_column(graph)
    return F.concat(graph, F.repeat(F.lit(" )"), unmatched_open_parens(graph)))


def parens_balanced(graph: Column | str) -> Column:
    """True when the raw text has both parentheses and, outside quotes, they nest."""
    graph = as_column(graph)
    only = F.regexp_replace(outside_quotes(graph), "[^()]", "")
    walk = F.aggregate(
        F.split(only, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, ch: _step(acc, ch),
        lambda acc: (acc["depth"] == 0) & (acc["lowest"] >= 0),
    )
    return graph.contains("(") & graph.contains(")") & walk


def _step(acc: Column, ch: Column) -> Column:
    depth = acc["depth"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)
    return F.struct(depth.alias("depth"), F.least(acc["lowest"], depth).alias("lowest"))


def linear_tokens(graph: Column | str) -> Column:
    """Tokens of the linear form: quoted one-word values stay whole, all else is split.

    A quoted value with blanks is cut at the blanks, and its parts are padded like
    unquoted text.
    """
    text = F.replace(as_column(graph), F.lit("–"), F.lit("-"))
    text = F.regexp_replace(text, r'(?d)(".+?")', " $1 ")
    pieces = F.split(strip_unicode(text), r"(?U)[\s\x1c-\x1f]+")
    padded = F.transform(
        pieces,
        lambda p: F.when(p.startswith('"') & p.endswith('"'), p).otherwise(
            F.replace(F.regexp_replace(p, "([()/])", " $1 "), F.lit(":"), F.lit(" :"))
        ),
    )
    joined = strip_unicode(F.regexp_replace(F.array_join(padded, " "), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.split(joined, " ")


def linearize(graph: Column | str) -> Column:
    """The graph on one line with single blanks between all tokens."""
    return F.array_join(linear_tokens(graph), " ")


# --- canonical text ------------------------------------------------------------

_ALIGNMENT = r'("[^"]*")|~(?:[A-Za-z]\.?)?[0-9]+(?:,[0-9]+)*(?=[\s()/]|$)'
_WIKI = r'("[^"]*")|(?<![^\s()"]):wiki(?![^\s()"])\s*(?:"[^"]*"|[^\s()"]+)'
_TOKEN = r'"[^"]*"|[()]|[^\s()"]+'


def drop_comments(graph: Column | str) -> Column:
    """Remove ``#`` metadata lines in front of or inside a graph."""
    graph = as_column(graph)
    cleaned = F.regexp_replace(graph, r"(?m)^[ \t]*#.*$", "")
    return F.when(graph.contains("#"), cleaned).otherwise(graph)


def drop_alignments(graph: Column | str) -> Column:
    """Remove surface alignments such as ``~e.4`` behind a token."""
    graph = as_column(graph)
    return F.when(graph.contains("~"), F.regexp_replace(graph, _ALIGNMENT, "$1")).otherwise(graph)


def drop_wiki(graph: Column | str) -> Column:
    """Remove every ``:wiki value`` pair from the text (the exact role name only)."""
    return F.regexp_replace(as_column(graph), _WIKI, "$1")


def encode_graph(graph: Column | str, remove_wiki: bool = True) -> Column:
    """Canonical one-line text: no metadata, no alignments, one blank between tokens.

    Text order is kept and quoted values stay whole.
    """
    text = drop_alignments(drop_comments(graph))
    if remove_wiki:
        text = drop_wiki(text)
    return F.array_join(F.regexp_extract_all(_spaced_slash(text), F.lit(_TOKEN), 0), " ")


def _spaced_slash(text: Column) -> Column:
    # '(b/boy' and '(b / boy' are the same node; quoted spans only gain blanks behind them.
    opening = r'("[^"]*")|(\(\s*[^\s()":/][^\s()"/]*)\s*(/)\s*'
    return F.regexp_replace(text, opening, "$1$2 $3 ")


# --- decoding ------------------------------------------------------------------

# One match per step of the walk: [role] node opening | role atom, each with the ')' behind it.  Only
# the root goes without a role, and a role gives nothing back to the atom behind it.  A lone '/'
# and a text that starts with ':' are no atoms.  A ')' in front of all steps is one by itself.
_ATOM = r'"[^"]*"|(?!/(?![^\s()"]))[^\s()":][^\s()"]*'
_VARIABLE = r'"[^"]*"|[^\s()":/][^\s()"/]*'
_STEP = rf'(?:^|(:[^\s()"]*+))\s*(?:\(\s*({_VARIABLE})\s*/\s*({_ATOM})|({_ATOM}))((?:\s*\))*+)|\)'

# A marked text has a record per step, closed by _END; what no step covers stays behind it.
_RECORD, _FIELD, _END = "\x1e", "\x1f", "\x1d"
_ROLE, _VAR, _CONCEPT, _VALUE, _CLOSED = range(5)  # fields of a record; all empty for a ')' by itself


def mark_steps(graph: Column | str) -> Column:
    """The text rewritten in one pass to a record of fields per step of the walk."""
    graph = as_column(graph)
    marks = _RECORD + _FIELD + _END
    any_mark = graph.contains(_RECORD) | graph.contains(_FIELD) | graph.contains(_END)
    plain = F.when(any_mark, F.translate(graph, marks, "   ")).otherwise(graph)
    fields = _FIELD.join(f"${k}" for k in range(1, 6))
    return F.regexp_replace(plain, _STEP, _RECORD + fields + _FIELD + _END)


def steps_legal(graph: Column | str, marked: Column | str) -> Column:
    """True when quotes pair up and the walk's steps cover the whole text."""
    graph, marked = as_column(graph), as_column(marked)
    return (
        (_occurrences(graph, '"') % 2 == 0)
        & graph.rlike(r"^\s*\(")
        & ~marked.rlike(rf"{_END}\s*[^\s{_RECORD}]")
    )


_TO_END = 1 << 30  # longer than any array


def walk_steps(marked: str) -> Column:
    """Array of steps, each an array of its fields.  Text before the first record is blank."""
    return F.expr(
        f"transform(slice(split({marked}, '{_RECORD}'), 2, {_TO_END}), "
        f"record -> split(record, '{_FIELD}'))"
    )


# Steps per inner fold.  A text grows by copying, so one fold over a graph of n steps would
# copy n * n characters; folds of this size keep the work close to linear.
_STEPS_PER_FOLD = 256


def walk_sources(steps: str) -> Column:
    """Fold the steps over a stack of open variables.

    Gives ``(depth, sources, depths)``: the open nodes left at the end, and for every step
    the variable it hangs from (empty outside any node) and how deep it stands.  Both are
    collected as text, which grows much faster than an array does, and split at the end.
    """
    var, atom, closed = f"step[{_VAR}]", f"step[{_VALUE}]", f"step[{_CLOSED}]"
    seen = (
        f"'sources', concat(fold.sources, get(fold.stack, 0), '{_FIELD}'), "
        f"'depths', concat(fold.depths, fold.depth, '{_FIELD}')"
    )
    # As many as there are ')' among blanks.  One too many empties the stack, below which is nothing.
    n = f"if({closed} = ')', 1, length({closed}) - length(translate({closed}, ')', '')))"

    def state(stack: str, depth: str) -> str:
        return f"named_struct('stack', {stack}, 'depth', {depth}, {seen})"

    return F.expr(
        f"""
        aggregate(
          sequence(1, greatest(size({steps}), 1), {_STEPS_PER_FOLD}),
          named_struct('stack', array(''), 'depth', 0, 'sources', '', 'depths', ''),
          (acc, start) -> aggregate(
            slice({steps}, start, {_STEPS_PER_FOLD}),
            named_struct('stack', acc.stack, 'depth', acc.depth, 'sources', '', 'depths', ''),
            (fold, step) -> CASE
              WHEN {var} <> '' THEN CASE {closed}
                WHEN '' THEN {state(f"array_prepend(fold.stack, {var})", "fold.depth + 1")}
                WHEN ')' THEN {state("fold.stack", "fold.depth")}
                ELSE {state(f"slice(fold.stack, {n}, {_TO_END})", f"fold.depth + 1 - {n}")} END
              WHEN {atom} <> '' THEN if({closed} = '', {state("fold.stack", "fold.depth")},
                {state(f"slice(fold.stack, {n} + 1, {_TO_END})", f"fold.depth - {n}")})
              ELSE {state("fold.stack", "fold.depth - 1")} END,
            fold -> named_struct(
              'stack', fold.stack, 'depth', fold.depth,
              'sources', concat(acc.sources, fold.sources),
              'depths', concat(acc.depths, fold.depths))),
          acc -> named_struct(
            'depth', acc.depth,
            'sources', split(acc.sources, '{_FIELD}'), 'depths', split(acc.depths, '{_FIELD}')))
        """
    )


def triples_of(steps: str, walk: str, non_inverse_roles: Sequence[str] = ()) -> Column:
    """Triples ``(depth, source, role, target, kind, inverted)`` of a walk, in text order."""
    role, var, concept, atom = (f"step[{k}]" for k in (_ROLE, _VAR, _CONCEPT, _VALUE))
    here, depth = f"get({walk}.sources, i)", f"cast(get({walk}.depths, i) AS int)"

    def triple(depth, source, role, target, kind, inverted="false") -> str:
        return (
            f"named_struct('depth', {depth}, 'source', {source}, 'role', {role}, "
            f"'target', {target}, 'kind', '{kind}', 'inverted', {inverted})"
        )

    def edge(target: str) -> str:
        turned = f"endswith({role}, '-of')"
        if non_inverse_roles:
            kept = ", ".join("'" + r.replace("'", "\\'") + "'" for r in non_inverse_roles)
            turned += f" AND {role} NOT IN ({kept})"
        plain = f"substring({role}, 1, length({role}) - 3)"
        swapped = triple(depth, target, plain, here, "edge", "true")
        straight = triple(depth, here, role, target, "edge")
        return f"CASE WHEN {turned} THEN {swapped} ELSE {straight} END"

    node = triple(f"{depth} + 1", var, "':instance'", concept, "instance")
    attribute = triple(depth, here, role, atom, "attribute")
    # Variables that occur as an atom too, mostly few.  transform() over one element gives
    # them a name: inside the lambda they would be worked out at every step.
    pointed_at = (
        f"array_intersect(transform({steps}, s -> s[{_VAR}]), transform({steps}, s -> s[{_VALUE}]))"
    )
    return F.expr(
        f"""
        get(transform(array({pointed_at}), pointed_at -> flatten(transform({steps}, (step, i) -> CASE
          WHEN {var} <> '' THEN if({role} <> '', array({edge(var)}, {node}), array({node}))
          WHEN array_contains(pointed_at, {atom}) THEN array({edge(atom)})
          ELSE array({attribute}) END))), 0)
        """
    )
