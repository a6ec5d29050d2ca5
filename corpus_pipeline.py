"""From raw documents to clean, encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, all columns of
``documents`` included; the last one adds the token ids.  ``run`` writes each stage's rows as
Parquet below the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import encode_texts
from graphloom.llm.decontaminate import drop_contaminated
from graphloom.llm.ngram_join import near_copies
from graphloom.llm.quality import score_quality
from graphloom.llm.queries import WORD_BPE, table, taught_labels
from graphloom.llm.secrets import scan_secrets
from graphloom.session import materialize

ROW = "__row"


def _whole(docs: DataFrame) -> Column:
    """A row as one struct, so that no column of it can clash with a new one."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier predicts as good."""
    # By place, so that no name can clash with a new one; the text travels once.
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    labels = taught_labels(spark, sf_dir).withColumnRenamed("doc_id", names["doc_id"])
    good = score_quality(rows, labels, names["doc_id"], names["text"]).filter("predicted = 1")
    return good.select(*[F.col(n).alias(c) for c, n in names.items()])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; rows without id come last.

    Rows are told apart by a key of their own: ids may be null or repeat, and a unique text stays
    whatever its id is."""
    keyed = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    groups = near_copies(keyed, doc_id=ROW, row=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    ranked = groups.join(keyed.select(ROW, "doc_id"), ROW)
    first = ranked.groupBy("component_id").agg(F.min_by(ROW, place).alias(ROW)).select(ROW)
    return keyed.join(first, ROW, "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that do not hold too much of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and the length told anew."""
    rows = docs.select(_whole(docs), "text", "source")
    found = F.exists("findings", lambda c: c["secret"])
    new = {"text": F.col("redacted"), "n_chars": F.when(found, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))}
    return scan_secrets(rows).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, as little-endian unsigned 32-bit integers in ``ids``."""
    return encode_texts(docs, WORD_BPE)


STAGES = [
    ("quality", quality),
    ("near copies", one_of_each_group),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("encode", encode),
]
#: No SQL gives scores, merges and ids; the stages are tested against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
