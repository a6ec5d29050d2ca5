"""Queries over the graph column of ``orders``: decoding, checking and scoring.

The checking SQL never parses a graph: triples, verdicts and scores follow from the
relational columns the graphs were written from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog.order_graphs import FACTS_SQL, graph_text, items_text, order_facts, order_graphs, quantity
from graphloom.catalog.registry import query
from graphloom.functions import graph_text as G
from graphloom.functions import text as X
from graphloom.operators import corpus as C
from graphloom.operators import graph as GR
from graphloom.operators import score as SC
from graphloom.operators import stats as ST
from graphloom.operators import validate as V
from graphloom.plans.corpus_build import build_corpus
from graphloom.session import fresh_path
from graphloom.sources.blocks import read_graph_blocks, read_graph_blocks_by_paragraph
from graphloom.sources.lexicon import lexicon_rows, parse_lexicon

# --- expected values ----------------------------------------------------------------

# Triples of every graph in text order.
_TRIPLES = f"""{FACTS_SQL},
triples AS (
  SELECT gid, 0 AS pos, 1 AS depth, 'o' AS source, ':instance' AS role, root AS target,
         'instance' AS kind, false AS inverted FROM facts
  UNION ALL SELECT gid, 1, 1, 'o', ':ARG0', 'c', 'edge', false FROM facts
  UNION ALL SELECT gid, 2, 2, 'c', ':instance', 'customer', 'instance', false FROM facts
  UNION ALL SELECT gid, 3, 2, 'c', ':wiki', '"' || cname || '"', 'attribute', false FROM facts
  UNION ALL SELECT gid, 4, 2, 'c', ':name', 'n', 'edge', false FROM facts
  UNION ALL SELECT gid, 5, 3, 'n', ':instance', 'name', 'instance', false FROM facts
  UNION ALL SELECT gid, 6, 3, 'n', ':op1', '"' || cname || '"', 'attribute', false FROM facts
  UNION ALL SELECT gid, 7, 1, 'o', ':ARG1', 'a', 'edge', false FROM facts
  UNION ALL SELECT gid, 8, 2, 'a', ':instance', 'and', 'instance', false FROM facts
  UNION ALL SELECT gid, 6 + 3 * i, 2, 'a', ':op' || i, 'p' || i, 'edge', false FROM items
  UNION ALL SELECT gid, 7 + 3 * i, 3, 'p' || i, ':instance', 'part', 'instance', false FROM items
  UNION ALL SELECT gid, 8 + 3 * i, 3, 'p' || i, ':quant', CAST(quant AS VARCHAR), 'attribute',
                   false FROM items
  UNION ALL SELECT gid, 9 + 3 * n_items, 1, 's', ':ARG2', 'o', 'edge', true FROM facts
  UNION ALL SELECT gid, 10 + 3 * n_items, 2, 's', ':instance', 'ship-01', 'instance', false FROM facts
  UNION ALL SELECT gid, 11 + 3 * n_items, 2, 's', ':ARG0', 'c', 'edge', false FROM facts
  UNION ALL SELECT gid, 12 + 3 * n_items, 1, 'o', ':polarity', '-', 'attribute', false FROM facts
  UNION ALL SELECT gid, 13 + 3 * n_items, 1, 'o', ':mod', '"' || prio || '"', 'attribute', false
            FROM facts
)
"""


def _text_sql(open_: str, close: str, wiki: bool = True) -> str:
    """The graph as text, with the given spelling of parentheses."""
    wiki_sql = """ || ' :wiki "' || cname || '"'""" if wiki else ""
    return f"""'{open_}o / ' || root || ' :ARG0 {open_}c / customer'{wiki_sql} ||
  ' :name {open_}n / name :op1 "' || cname || '"{close}{close} :ARG1 {open_}a / and ' || listed ||
  '{close} :ARG2-of {open_}s / ship-01 :ARG0 c{close} :polarity - :mod "' || prio || '"{close}'"""


def _listed_sql(open_: str, close: str) -> str:
    return f"""{FACTS_SQL},
listed AS (SELECT gid, string_agg(':op' || i || ' {open_}p' || i || ' / part :quant ' || quant ||
             '{close}', ' ' ORDER BY i) AS listed FROM items GROUP BY gid),
whole AS (SELECT f.*, l.listed FROM facts f JOIN listed l ON f.gid = l.gid)
"""


_PLAIN = _listed_sql("(", ")")
_SPACED = _listed_sql("( ", " )")


# Kinds of damage by gid % 7: none, cut, one ")" too many, open quote, variable declared
# twice, text behind the root, no graph at all.
def damaged() -> Column:
    graph = F.col("graph")
    twice = F.replace(graph, F.lit("(n / name"), F.lit("(c / name"))
    variants = [
        graph,
        F.substring(graph, F.lit(1), F.length(graph) - 1),
        F.concat(graph, F.lit(")")),
        F.concat(graph, F.lit(' "')),
        twice,
        F.concat(graph, F.lit(" tail")),
    ]
    expr = None
    for k, text in enumerate(variants):
        expr = (F if expr is None else expr).when(F.col("gid") % 7 == k, text)
    return expr


_DAMAGED = f"""{_PLAIN},
texts AS (SELECT gid, {_text_sql("(", ")")} AS good FROM whole),
damaged AS (SELECT gid, CASE gid % 7 WHEN 0 THEN good
  WHEN 1 THEN substr(good, 1, length(good) - 1) WHEN 2 THEN good || ')' WHEN 3 THEN good || ' "'
  WHEN 4 THEN replace(good, '(n / name', '(c / name') WHEN 5 THEN good || ' tail' END AS graph,
  good FROM texts)
"""


def damaged_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_graphs(spark, sf_dir).select("gid", damaged().alias("graph"))


def decoded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = order_graphs(spark, sf_dir).select("gid", "graph")
    return GR.decode_graphs(graphs, "graph")


# --- decoding -----------------------------------------------------------------------


@query(
    "amr_triples",
    f"WITH {_TRIPLES} SELECT gid, pos, depth, source, role, target, kind, inverted FROM triples",
)
def amr_triples(spark, sf_dir):
    return GR.explode_triples(decoded_orders(spark, sf_dir).select("gid", "triples"))


@query(
    "inverse_roles",
    f"WITH {_TRIPLES} SELECT gid, pos, source, role, target FROM triples WHERE inverted",
)
def inverse_roles(spark, sf_dir):
    rows = GR.explode_triples(decoded_orders(spark, sf_dir).select("gid", "triples"))
    return rows.filter("inverted").select("gid", "pos", "source", "role", "target")


@query(
    "inverse_roles_kept",
    f"""WITH {FACTS_SQL} SELECT gid, 'o' AS source, ':ARG2-of' AS role, 's' AS target FROM facts""",
)
def inverse_roles_kept(spark, sf_dir):
    """A role listed as not inverse stays as it is written."""
    graphs = order_graphs(spark, sf_dir).select("gid", "graph")
    decoded = GR.decode_graphs(graphs, "graph", non_inverse_roles=[":ARG2-of"])
    rows = GR.explode_triples(decoded.select("gid", "triples"))
    return rows.filter("role = ':ARG2-of'").select("gid", "source", "role", "target")


@query(
    "strip_wiki",
    f"""WITH {_TRIPLES} SELECT gid, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places
FROM triples WHERE role <> ':wiki' GROUP BY gid""",
)
def strip_wiki(spark, sf_dir):
    rows = GR.explode_triples(decoded_orders(spark, sf_dir).select("gid", "triples"))
    kept = GR.remove_wiki_triples(rows)
    return kept.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


@query(
    "encode_graph",
    f"""WITH {_SPACED} SELECT gid, {_text_sql("( ", " )", wiki=False)} AS encoded FROM whole""",
)
def encode_graph(spark, sf_dir):
    aligned = F.replace(F.col("graph"), F.lit("/ customer"), F.lit("/ customer~e.3,4"))
    text = F.concat(F.lit("# ::id x\n"), aligned)
    return order_graphs(spark, sf_dir).select("gid", G.encode_graph(text).alias("encoded"))


@query(
    "linearize",
    f"""WITH {_SPACED} SELECT gid, {_text_sql("( ", " )")} AS linear FROM whole""",
)
def linearize(spark, sf_dir):
    spread_out = F.replace(F.replace(F.col("graph"), F.lit(" :ARG"), F.lit("\n   :ARG")), F.lit("-01"), F.lit("–01"))
    return order_graphs(spark, sf_dir).select("gid", G.linearize(spread_out).alias("linear"))


@query(
    "normalize_graphs",
    f"""WITH {_SPACED} SELECT gid, {_text_sql("( ", " )", wiki=False)} AS graph FROM whole""",
)
def normalize_graphs(spark, sf_dir):
    return GR.normalize_graphs(order_graphs(spark, sf_dir).select("gid", "graph"), "graph")


@query(
    "linear_tokens",
    f"""WITH {_SPACED}, lines AS (SELECT gid, {_text_sql("( ", " )")} AS line FROM whole)
SELECT token, count(*) AS count FROM (SELECT unnest(string_split(line, ' ')) AS token FROM lines)
GROUP BY token""",
)
def linear_tokens(spark, sf_dir):
    tokens = order_graphs(spark, sf_dir).select(F.explode_outer(G.linear_tokens("graph")).alias("token"))
    return ST.value_counts(tokens, "token", "token")


@query(
    "top_nodes",
    f"WITH {FACTS_SQL} SELECT root AS concept, count(*) AS count FROM facts GROUP BY root",
)
def top_nodes(spark, sf_dir):
    return ST.top_concept_counts(decoded_orders(spark, sf_dir))


@query(
    "node_concepts",
    f"""WITH {_TRIPLES} SELECT gid, string_agg(target, ' ' ORDER BY pos) AS concepts,
  count(*) AS n FROM triples WHERE kind = 'instance' GROUP BY gid""",
)
def node_concepts(spark, sf_dir):
    decoded = decoded_orders(spark, sf_dir)
    concepts = GR.node_concepts("triples")
    return decoded.select(
        "gid", F.array_join(concepts, " ").alias("concepts"), F.size(concepts).cast("long").alias("n")
    )


@query(
    "concept_counts",
    f"""WITH {_TRIPLES} SELECT target AS concept, count(*) AS count FROM triples
WHERE kind = 'instance' GROUP BY target""",
)
def concept_counts(spark, sf_dir):
    return ST.concept_counts(decoded_orders(spark, sf_dir))


@query(
    "inspect_graphs",
    f"""WITH {_SPACED} SELECT gid, {_text_sql("( ", " )")} AS encoded FROM whole
ORDER BY gid LIMIT 1000""",
)
def inspect_graphs(spark, sf_dir):
    first = ST.inspect_rows(order_graphs(spark, sf_dir), ["gid"])
    return first.select("gid", G.encode_graph("graph", remove_wiki=False).alias("encoded"))


# --- words of whole documents as graphs ----------------------------------------------


@query(
    "document_graph_roles",
    r"""WITH words AS (SELECT lang, regexp_extract_all(text, '[^\s()":/~#]+') AS w FROM documents),
roles AS (SELECT lang, ':instance' AS role, 1 + len(w) AS n FROM words
  UNION ALL SELECT lang, ':next', len(w) FROM words
  UNION ALL SELECT lang, ':len', len(w) FROM words)
SELECT lang, role, CAST(sum(n) AS BIGINT) AS n FROM roles GROUP BY lang, role""",
)
def document_graph_roles(spark, sf_dir):
    """One graph per document with a node per word: graphs of very different sizes."""
    from graphloom.catalog.text_queries import documents

    words = F.regexp_extract_all("text", F.lit(r'[^\s()":/~#]+'), 0)
    nodes = F.array_join(
        F.transform(
            words, lambda w, i: F.concat(F.lit(" :next (w"), i.cast("string"), F.lit(" / "), w,
                                         F.lit(" :len "), F.length(w).cast("string"), F.lit(")"))
        ),
        "",
    )
    graph = F.concat(F.lit("(d / document"), nodes, F.lit(")"))
    docs = documents(spark, sf_dir).select("doc_id", "lang", graph.alias("graph"))
    rows = GR.explode_triples(GR.decode_graphs(docs, "graph").select("lang", "triples"))
    return rows.groupBy("lang", "role").agg(F.count(F.lit(1)).alias("n"))


# --- checking -----------------------------------------------------------------------


@query(
    "paren_repair",
    f"""WITH {_DAMAGED} SELECT gid, CASE gid % 7 WHEN 1 THEN 1 ELSE 0 END AS missing,
  CASE gid % 7 WHEN 1 THEN graph || ' )' ELSE graph END AS repaired
FROM damaged WHERE graph IS NOT NULL""",
)
def paren_repair(spark, sf_dir):
    graphs = damaged_graphs(spark, sf_dir).dropna(subset=["graph"])
    return graphs.select(
        "gid",
        G.unmatched_open_parens("graph").alias("missing"),
        G.close_open_parens("graph").alias("repaired"),
    )


@query(
    "paren_valid",
    f"""WITH {FACTS_SQL} SELECT gid, CASE WHEN gid % 7 = 6 THEN 'no text'
  WHEN gid % 7 IN (1, 2) THEN 'false' ELSE 'true' END AS balanced FROM facts""",
)
def paren_valid(spark, sf_dir):
    return damaged_graphs(spark, sf_dir).select(
        "gid",
        F.coalesce(G.parens_balanced("graph").cast("string"), F.lit("no text")).alias("balanced"),
    )


@query("valid_filter", f"WITH {FACTS_SQL} SELECT gid FROM facts WHERE gid % 7 = 0")
def valid_filter(spark, sf_dir):
    return V.filter_valid(damaged_graphs(spark, sf_dir), "graph").select("gid")


@query(
    "valid_counts",
    f"""WITH {FACTS_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE gid % 7 <> 0) AS dropped
FROM facts""",
)
def valid_counts(spark, sf_dir):
    flagged = V.flag_valid(damaged_graphs(spark, sf_dir), "graph")
    return flagged.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("valid")).alias("dropped"))


def order_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon lines written from order states: ``finish-01`` lacks ARG1 and ``pend-01`` has
    no entry; each priority repeats the entry of ``ship-01``."""
    orders = order_facts(spark, sf_dir)
    roots = orders.select(
        "gid",
        F.when(F.col("root") == "order-01", "order-01  ARG0: who orders  ARG1: what  ARG2: from")
        .when(F.col("root") == "finish-01", "finish-01  ARG0: who: finally  ARG2: end")
        .otherwise("ship-01  ARG0: shipper  ARG2: what  ARG4")
        .alias("line"),
    )
    return parse_lexicon(roots, ["gid"])


@query(
    "frame_lexicon",
    f"""WITH {FACTS_SQL}
SELECT DISTINCT p AS predicate, l AS label, d AS description FROM facts JOIN (VALUES
  ('order-01', 'order-01', 'ARG0', 'who orders'), ('order-01', 'order-01', 'ARG1', 'what'),
  ('order-01', 'order-01', 'ARG2', 'from'), ('finish-01', 'finish-01', 'ARG0', 'who: finally'),
  ('finish-01', 'finish-01', 'ARG2', 'end'), ('pend-01', 'ship-01', 'ARG0', 'shipper'),
  ('pend-01', 'ship-01', 'ARG2', 'what'), ('pend-01', 'ship-01', 'ARG4', '')) AS v(r, p, l, d)
ON root = r""",
)
def frame_lexicon(spark, sf_dir):
    return lexicon_rows(order_lexicon(spark, sf_dir))


@query(
    "frame_check",
    f"WITH {FACTS_SQL} SELECT gid FROM facts WHERE root = 'finish-01'",
)
def frame_check(spark, sf_dir):
    roles = V.core_roles(decoded_orders(spark, sf_dir), ["gid"])
    return V.frame_violations(roles, order_lexicon(spark, sf_dir), ["gid"])


def connective_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ops by gid % 5: in order, from 2 on, a single op1, a single op2, none."""

    def numbered(first: int) -> Column:
        parts = F.transform(
            F.sequence(F.lit(1), F.col("n_items")),
            lambda i: F.format_string(":op%d (p%d / part)", i + (first - 1), i),
        )
        return F.array_join(parts, " ")

    k = F.col("gid") % 5
    items = (
        F.when(k == 0, numbered(1)).when(k == 1, numbered(2)).when(k == 2, ":op1 (p1 / part)")
        .when(k == 3, ":op2 (p2 / part)").otherwise("")
    )
    facts = order_facts(spark, sf_dir)
    return facts.select("gid", graph_text(items=items).alias("graph"))


@query(
    "and_or_check",
    f"WITH {FACTS_SQL} SELECT gid, gid % 5 IN (0, 3) AS numbered FROM facts",
)
def and_or_check(spark, sf_dir):
    decoded = GR.decode_graphs(connective_variants(spark, sf_dir), "graph")
    return decoded.select("gid", V.connectives_numbered("triples").alias("numbered"))


@query(
    "validate_chain",
    f"""WITH {FACTS_SQL}, checked AS (SELECT gid, CASE
  WHEN gid % 7 IN (1, 2, 6) THEN 'parentheses' WHEN gid % 7 IN (3, 5) THEN 'decodes'
  WHEN gid % 7 = 4 THEN 'parses' WHEN root = 'finish-01' THEN 'frames' END AS first_failure
FROM facts) SELECT gid, first_failure, first_failure IS NULL AS valid FROM checked""",
)
def validate_chain(spark, sf_dir):
    checked = V.validate_graphs(
        damaged_graphs(spark, sf_dir), "graph", ["gid"], order_lexicon(spark, sf_dir)
    )
    return checked.select("gid", "first_failure", "valid")


# Filtered triples as text: by gid, the customer opens below the shipment, or the other way round.
_ENCODED = f"""{_PLAIN}, parts AS (SELECT gid, 'c / customer :name (n / name :op1 "' || cname || '")' AS cust_text,
  ' :ARG1 (a / and ' || listed || ')' AS both_text, root, prio FROM whole)
SELECT gid, CASE gid % 2
  WHEN 0 THEN '(o / ' || root || both_text || ' :ARG2-of (s / ship-01 :ARG0 (' || cust_text || '))'
  ELSE '(o / ' || root || ' :ARG0 (' || cust_text || ' :ARG0-of (s / ship-01))' || both_text END
  || ' :mod "' || prio || '")' AS graph FROM parts"""


def filtered_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = GR.remove_wiki_triples(GR.explode_triples(decoded_orders(spark, sf_dir).select("gid", "triples")))
    to_customer = (F.col("source") == "o") & (F.col("role") == ":ARG0") & (F.col("gid") % 2 == 0)
    to_shipment = F.col("inverted") & (F.col("gid") % 2 == 1)
    return rows.filter(~to_customer & ~to_shipment & (F.col("role") != ":polarity"))


@query("encode_triples", f"WITH {_ENCODED}")
def encode_triples(spark, sf_dir):
    """Graphs written from the flat triples table after a filter."""
    return GR.encode_triples(filtered_triples(spark, sf_dir), ["gid"])


# --- scoring ------------------------------------------------------------------------


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and prediction by gid % 7: equal with other variable names and its branches in
    another order, other root, no polarity, other quantities, cut (repaired), broken prediction,
    broken reference."""
    k = F.col("gid") % 7
    other = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.col("n_items")),
            lambda i: F.format_string(":op%d (p%d / part :quant %d)", i, i, quantity(i) + 1),
        ),
        " ",
    )
    graphs = order_graphs(spark, sf_dir)
    graph = F.col("graph")
    turned = F.array_join(F.reverse(F.split(items_text(), " (?=:op)")), " ")
    shuffled = F.concat(
        F.lit("(o / "), F.col("root"), F.lit(' :mod "'), F.col("prio"), F.lit('" :ARG1 (z9 / and '),
        turned, F.lit(") :polarity - :ARG2-of (s / ship-01 :ARG0 (p0 / customer :name (n / name :op1 \""),
        F.col("cname"), F.lit('") :wiki "'), F.col("cname"), F.lit('")) :ARG0 p0)'),
    )
    pred = (
        F.when(k == 0, shuffled)
        .when(k == 1, graph_text(root=F.lit("other-01")))
        .when(k == 2, graph_text(polarity=F.lit("")))
        .when(k == 3, graph_text(items=other))
        .when(k == 4, F.substring(graph, F.lit(1), F.length(graph) - 1))
        .when(k == 5, F.concat(F.lit(":"), graph))
        .otherwise(graph)
    )
    ref = F.when(k == 6, F.substring(graph, F.lit(1), F.length(graph) - 1)).otherwise(graph)
    return graphs.select("gid", ref.alias("ref"), pred.alias("pred"))


def _scores_sql(matched: str) -> str:
    """Counts and ratios for the pairs above; ``t`` is the number of reference triples."""
    return f"""{FACTS_SQL},
sized AS (SELECT gid, gid % 7 AS v, n_items, 14 + 3 * n_items AS t FROM facts),
counted AS (SELECT gid, v NOT IN (5, 6) AS parsable,
  CASE WHEN v IN (5, 6) THEN 0 ELSE {matched} END AS matched,
  CASE WHEN v IN (5, 6) THEN 0 WHEN v = 2 THEN t - 1 ELSE t END AS n_pred,
  CASE WHEN v IN (5, 6) THEN 0 ELSE t END AS n_ref FROM sized),
scores AS (SELECT gid, parsable, matched, n_pred, n_ref,
  CASE WHEN n_pred = 0 THEN 0.0 ELSE CAST(matched AS DOUBLE) / n_pred END AS p,
  CASE WHEN n_ref = 0 THEN 0.0 ELSE CAST(matched AS DOUBLE) / n_ref END AS r,
  CASE WHEN n_ref = 0 THEN 0.0 ELSE 2 * CAST(matched AS DOUBLE) / (n_pred + n_ref) END AS f
  FROM counted)
"""


_OVERLAP = _scores_sql(
    "CASE v WHEN 1 THEN t - 7 WHEN 2 THEN t - 1 WHEN 3 THEN t - n_items ELSE t END"
)
_ALIGNED = _scores_sql(
    "CASE v WHEN 1 THEN t - 2 WHEN 2 THEN t - 1 WHEN 3 THEN t - n_items ELSE t END"
)
# One round: a changed root changes its own label and those of its three neighbours.
_AROUND = _scores_sql(
    "CASE v WHEN 1 THEN 2 + 2 * n_items WHEN 2 THEN t - 1 WHEN 3 THEN t - n_items ELSE t END"
)
_SCORE_COLUMNS = """gid, parsable, round(f, 6) AS smatchpp_f1, round(p, 6) AS smatchpp_prec,
  round(r, 6) AS smatchpp_rec"""


def _rounded(scored: DataFrame) -> DataFrame:
    numbers = [F.round(c, 6).alias(c) for c in ("smatchpp_f1", "smatchpp_prec", "smatchpp_rec")]
    return scored.select("gid", "parsable", *numbers)


@query("overlap_scores", f"WITH {_OVERLAP} SELECT {_SCORE_COLUMNS} FROM scores")
def overlap_scores(spark, sf_dir):
    return _rounded(SC.score_pairs(scored_pairs(spark, sf_dir), "ref", "pred", method="overlap"))


@query("aligned_scores", f"WITH {_ALIGNED} SELECT {_SCORE_COLUMNS} FROM scores")
def aligned_scores(spark, sf_dir):
    return _rounded(SC.score_pairs(scored_pairs(spark, sf_dir), "ref", "pred"))


@query("neighbourhood_scores", f"WITH {_AROUND} SELECT {_SCORE_COLUMNS} FROM scores")
def neighbourhood_scores(spark, sf_dir):
    pairs = scored_pairs(spark, sf_dir)
    return _rounded(SC.score_pairs(pairs, "ref", "pred", method="overlap", rounds=1))


_PLAIN_PARTS = f"""{_PLAIN}, spaced_items AS (SELECT gid, string_agg(':op' || i || ' ( p' || i ||
  ' / part :quant ' || quant || ' )', ' ' ORDER BY i) AS listed FROM items GROUP BY gid),
spaced AS (SELECT f.gid, {_text_sql("( ", " )", wiki=False)} AS text
  FROM facts f JOIN spaced_items l ON f.gid = l.gid),
plain AS (SELECT gid, {_text_sql("(", ")")} AS good FROM whole)
"""


@query(
    "scored_texts",
    f"""WITH {_PLAIN_PARTS} SELECT p.gid, CASE p.gid % 7 WHEN 5 THEN good
  WHEN 6 THEN substr(good, 1, length(good) - 1) ELSE text END AS ref
FROM plain p JOIN spaced s ON p.gid = s.gid""",
)
def scored_texts(spark, sf_dir):
    """Parsable rows carry the canonical reference, all others their own text."""
    scored = SC.score_pairs(scored_pairs(spark, sf_dir), "ref", "pred", method="overlap")
    return scored.select("gid", "ref")


@query(
    "eval_report",
    f"""WITH {_ALIGNED} SELECT round(avg(f), 6) AS f1_mean, round(avg(p), 6) AS precision_mean,
  round(avg(r), 6) AS recall_mean, count(*) FILTER (WHERE NOT parsable) AS unparsable FROM scores""",
)
def eval_report(spark, sf_dir):
    report = SC.evaluation_report(SC.score_pairs(scored_pairs(spark, sf_dir), "ref", "pred"))
    means = [F.round(c, 6).alias(c) for c in ("f1_mean", "precision_mean", "recall_mean")]
    return report.select(*means, "unparsable")


# Without repair the cut predictions (gid % 7 = 4) count for nothing as well.
@query(
    "corpus_score",
    f"""WITH {_ALIGNED}, kept AS (SELECT * FROM counted WHERE gid % 7 <> 4)
SELECT CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(n_pred) AS BIGINT) AS n_pred,
  CAST(sum(n_ref) AS BIGINT) AS n_ref, round(sum(matched) / sum(n_pred), 6) AS precision,
  round(sum(matched) / sum(n_ref), 6) AS recall,
  round(2 * sum(matched) / (sum(n_pred) + sum(n_ref)), 6) AS f1 FROM kept""",
)
def corpus_score(spark, sf_dir):
    pairs = scored_pairs(spark, sf_dir)
    shown = {
        c: X.render_prompt(F.lit("x"), c, template="Text: {}\nAMR: {}") for c in ("ref", "pred")
    }
    total = SC.corpus_score(pairs.withColumns(shown), "ref", "pred", marker="\nAMR: ")
    ratios = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return total.select("matched", "n_pred", "n_ref", *ratios)


# --- files and the whole corpus -----------------------------------------------------


def block_text() -> Column:
    """A record of a block file: a translation header, metadata, and a graph over lines."""
    graph = F.replace(F.col("graph"), F.lit(" :ARG"), F.lit("\n    :ARG"))
    return F.concat(
        F.lit("# ::snt_hu "), F.col("cname"), F.lit("\n# ::id o"), F.col("gid").cast("string"),
        F.lit(" ::date 2020-01-01\n# ::snt "), F.col("prio"), F.lit(" by "), F.col("cname"),
        F.lit("\n"), graph, F.lit("\n"),
    )


_BLOCKS = f"""WITH {_PLAIN} SELECT 'o' || gid AS id, prio || ' by ' || cname AS sentence,
  replace({_text_sql("(", ")")}, ' :ARG', chr(10) || '    :ARG') AS amr_graph FROM whole"""


def written_blocks(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "blocks")
    order_graphs(spark, sf_dir).select(block_text().alias("value")).write.text(path)
    return path


@query("block_roundtrip", _BLOCKS)
def block_roundtrip(spark, sf_dir):
    records = read_graph_blocks(spark, written_blocks(spark, sf_dir))
    return records.select("id", "sentence", "amr_graph")


@query("block_roundtrip_fast", _BLOCKS)
def block_roundtrip_fast(spark, sf_dir):
    records = read_graph_blocks_by_paragraph(spark, written_blocks(spark, sf_dir))
    return records.select("id", "sentence", "amr_graph")


@query(
    "corpus_build",
    f"""WITH {_SPACED}, records AS (SELECT gid, CAST(gid AS VARCHAR) AS id,
    prio || ' by ' || cname AS en, CASE WHEN root <> 'pend-01' THEN prio || ' tőle: ' || cname END
    AS hu, {_text_sql("( ", " )", wiki=False)} AS amr_graph,
    CASE gid % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'training' END AS split FROM whole),
sides AS (SELECT gid, id, en AS sentence, amr_graph, split, 'EN' AS lang, 0 AS o FROM records
  UNION ALL SELECT gid, id, hu, amr_graph, split, 'HU', 1 FROM records WHERE hu IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY
    CASE split WHEN 'test' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END, o, gid) AS rn FROM sides)
SELECT id, sentence, amr_graph, split, lang FROM ranked WHERE rn = 1""",
)
def corpus_build(spark, sf_dir):
    """Records and partly missing translations to one row per sentence, linear graphs."""
    graphs = order_graphs(spark, sf_dir)
    r = F.col("gid") % 10
    records = graphs.select(
        "gid",
        F.col("gid").cast("string").alias("id"),
        F.concat("prio", F.lit(" by "), "cname").alias("sentence"),
        F.col("graph").alias("amr_graph"),
        F.when(r == 0, "test").when(r == 1, "dev").otherwise("training").alias("split"),
    )
    translations = order_facts(spark, sf_dir).select(
        F.col("gid").cast("string").alias("id"),
        F.when(
            F.col("root") != "pend-01", F.concat("prio", F.lit(" tőle: "), "cname")
        ).alias("hu_sentence"),
    )
    return build_corpus(records, translations, record_order=("gid",))
