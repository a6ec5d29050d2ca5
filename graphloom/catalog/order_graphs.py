"""A graph column over the order tables, so that graph operators run on whole tables.

One graph per order, written from the columns of ``orders`` and ``customer``; the
expected triples, verdicts and scores follow from the same columns without parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Graphs are decoded and matched in tasks of about so many: a task's work stays what it is as the
# tables grow, whatever the row groups of their files are.
_ORDERS_PER_TASK = 20_000


def in_small_tasks(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` of about ``rows`` rows spread by ``key`` over tasks of bounded size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // _ORDERS_PER_TASK)), key)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan with fewer splits than cores before costly narrow work.

    A large table has splits enough and is passed through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gid, root, cname, prio, n_items, cust`` per order, all rows of a ``gid`` in one task."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    root = (
        F.when(F.col("o_orderstatus") == "O", "order-01")
        .when(F.col("o_orderstatus") == "F", "finish-01")
        .otherwise("pend-01")
    )
    facts = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("gid"),
        root.alias("root"),
        F.col("c_name").alias("cname"),
        F.col("o_orderpriority").alias("prio"),
        (2 + F.floor("o_totalprice") % 5).cast("int").alias("n_items"),
        F.col("o_custkey").alias("cust"),
    )
    # After the join, which a large customer table turns into few large tasks; the count reads footers.
    return in_small_tasks(facts, "gid", orders.count())


# The same facts for the checking engine.
FACTS_SQL = """
facts AS (
  SELECT o_orderkey AS gid,
         CASE o_orderstatus WHEN 'O' THEN 'order-01' WHEN 'F' THEN 'finish-01'
              ELSE 'pend-01' END AS root,
         c_name AS cname, o_orderpriority AS prio,
         CAST(2 + CAST(floor(o_totalprice) AS BIGINT) % 5 AS INTEGER) AS n_items,
         o_custkey AS cust
  FROM orders JOIN customer ON o_custkey = c_custkey
),
items AS (
  SELECT gid, cust, n_items, CAST(i AS INTEGER) AS i, 1 + (cust + 7 * i) % 50 AS quant
  FROM facts, unnest(range(1, n_items + 1)) AS u(i)
)
"""


def quantity(i: Column) -> Column:
    return 1 + (F.col("cust") + 7 * i) % 50


def items_text(first: int = 1) -> Column:
    """``:op<n> (p<n> / part :quant <q>)`` for every item, numbered from ``first``."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.col("n_items")),
            lambda i: F.format_string(
                ":op%d (p%d / part :quant %d)", i + (first - 1), i, quantity(i)
            ),
        ),
        " ",
    )


def graph_text(
    root: Column | None = None,
    customer_concept: Column | None = None,
    items: Column | None = None,
    polarity: Column | None = None,
) -> Column:
    """The graph of an order, with parts that may be replaced to perturb it."""
    root = F.col("root") if root is None else root
    concept = F.lit("customer") if customer_concept is None else customer_concept
    items = items_text() if items is None else items
    polarity = F.lit(" :polarity -") if polarity is None else polarity
    return F.concat(
        F.lit("(o / "), root, F.lit(" :ARG0 (c / "), concept, F.lit(' :wiki "'), F.col("cname"),
        F.lit('" :name (n / name :op1 "'), F.col("cname"), F.lit('")) :ARG1 (a / and '), items,
        F.lit(") :ARG2-of (s / ship-01 :ARG0 c)"), polarity,
        F.lit(' :mod "'), F.col("prio"), F.lit('")'),
    )


def order_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_facts`` with the column ``graph``."""
    return order_facts(spark, sf_dir).withColumn("graph", graph_text())
