"""Corpus building: joins, unions, duplicates, languages, splits and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.constants import ALL_LANGUAGES, LANGUAGES, SPLIT_RANK
from graphloom.functions.text import as_column
from graphloom.session import materialize

CORPUS_COLUMNS = ("id", "sentence", "amr_graph", "split", "lang")
CORPUS_SCHEMA = ", ".join(f"{c} string" for c in CORPUS_COLUMNS)
DRAW_DIGITS = 4  # leading hexadecimal digits of a draw by which a sample counts rows


def keep_first(
    df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]
) -> DataFrame:
    """One row per key, the first in ``order``.

    Ranking runs before the shuffle too (a window group limit), so a key that holds a
    large part of all rows sends one row per task.
    """
    window = Window.partitionBy(*[as_column(k) for k in keys]).orderBy(*[as_column(c) for c in order])
    return df.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


def rank_of(column: Column | str, ranks: Mapping[str, int]) -> Column:
    """Rank of a value in a custom order; null for values without a rank."""
    expr = None
    for value, rank in ranks.items():
        expr = (F if expr is None else expr).when(as_column(column) == value, rank)
    return expr


def dedup_by_split(
    df: DataFrame,
    order: Sequence[Column | str],
    sentence: str = "sentence",
    split: str = "split",
    ranks: Mapping[str, int] = SPLIT_RANK,
) -> DataFrame:
    """One row per sentence: test before dev before training, then the given order."""
    rank = F.coalesce(rank_of(split, ranks), F.lit(len(ranks)))
    return keep_first(df, [sentence], [rank, *order])


def attach_translations(
    records: DataFrame, translations: DataFrame, key: str = "id"
) -> DataFrame:
    """Left join on ``key``; a null key meets a null key.  Translations hold one row per key."""
    right = translations.select(
        F.col(key).alias("__key"), *[c for c in translations.columns if c != key]
    )
    return records.join(right, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def first_with_translation(
    records: DataFrame,
    translations: DataFrame,
    record_order: Sequence[Column | str],
    translation_order: Sequence[Column | str],
    key: str = "id",
) -> DataFrame:
    """The first record of each ``key`` with the columns of the key's first translation beside it,
    null without one; a null key meets a null key.

    Both sides travel as one table and meet in one exchange, after which a key that holds a large
    part of all rows is one row per task.
    """

    def side(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
        place = F.struct(*[as_column(c).alias(f"o{i}") for i, c in enumerate(order)])
        return df.select(F.col(key).alias("__key"), place.alias(f"__{name}_place"), F.struct("*").alias(f"__{name}"))

    rows = side(records, record_order, "record").unionByName(
        side(translations, translation_order, "translation"), allowMissingColumns=True
    )
    first = rows.groupBy("__key").agg(
        *[F.min_by(f"__{name}", f"__{name}_place").alias(f"__{name}") for name in ("record", "translation")]
    )
    new = [c for c in translations.columns if c not in records.columns]
    return first.filter("__record IS NOT NULL").select("__record.*", *[F.col(f"__translation.{c}") for c in new])


def languages_to_rows(
    df: DataFrame,
    english: str = "sentence",
    hungarian: str = "hu_sentence",
    sentence: str = "sentence",
    order: str = "lang_order",
) -> DataFrame:
    """Two rows per record, tagged ``EN`` and ``HU``; HU rows without a sentence go.

    ``order`` numbers the EN block before the HU block.
    """
    kept = [c for c in df.columns if c not in (english, hungarian)]
    both = F.array(
        F.struct(
            F.col(english).alias(sentence), F.lit("EN").alias("lang"), F.lit(0).alias(order)
        ),
        F.struct(
            F.col(hungarian).alias(sentence), F.lit("HU").alias("lang"), F.lit(1).alias(order)
        ),
    )
    rows = df.select(*kept, F.inline(both))
    return rows.filter((F.col("lang") == "EN") | F.col(sentence).isNotNull())


def filter_language(df: DataFrame, language: str = ALL_LANGUAGES) -> DataFrame:
    if language == ALL_LANGUAGES:
        return df
    if language not in LANGUAGES:
        raise ValueError(f"language is one of {(*LANGUAGES, ALL_LANGUAGES)}, not {language!r}")
    return df.filter(F.col("lang") == language)


def split_views(
    corpus: DataFrame,
    train_language: str = ALL_LANGUAGES,
    dev_language: str = ALL_LANGUAGES,
    test_language: str = ALL_LANGUAGES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, dev and test rows, each in its language; test keeps only ``sentence``."""

    def view(split: str, language: str) -> DataFrame:
        return filter_language(corpus.filter(F.col("split") == split), language)

    return (
        view("training", train_language),
        view("dev", dev_language),
        view("test", test_language).select("sentence"),
    )


def draw_key(seed: int | str, keys: Sequence[Column | str]) -> Column:
    """A text that puts rows in random order, the same for the same seed and keys."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[as_column(k).cast("string") for k in keys]))


def exact_sample(
    df: DataFrame, n: int, keys: Sequence[str], seed: int | str, *, at_most: bool = False
) -> DataFrame:
    """``n`` rows drawn without replacement, the same for the same ``(seed, keys)``.

    The sample is the first ``n`` rows in draw order, as a set.  One pass counts rows by the
    first digits of their draw; rows below the digits where the n-th row lies are all kept where
    they stand, and only the rows with those very digits are sorted.  With ``at_most`` a smaller
    table is returned whole, otherwise it is an error.
    """
    draw = draw_key(seed, keys)
    digits = F.substring(draw, 1, DRAW_DIGITS)
    # At most 16 ** DRAW_DIGITS rows, so that the one window over all of them is short.
    counts = df.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("rows"))
    upto = counts.withColumn("upto", F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("digits")))
    found = upto.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.min(F.when(F.col("upto") >= n, F.struct("digits", "rows", "upto"))).alias("edge"),
    ).first()
    if found.total < n and not at_most:
        raise ValueError(f"cannot draw {n} rows out of {found.total}")
    if found.total <= n:
        return df
    below = found.edge["upto"] - found.edge["rows"]
    edge = df.filter(digits == found.edge["digits"]).orderBy(draw, *keys).limit(n - below)
    return df.filter(digits < found.edge["digits"]).unionByName(edge)


def shuffle_rows(
    df: DataFrame, keys: Sequence[str], seed: int | str, *, unique: bool = True
) -> DataFrame:
    """All rows in random order.

    With keys that tell rows apart the order is the same for the same ``(seed, keys)``.
    Copies of one key would sort into one task; with ``unique=False`` every row gets a
    number of its own first, written once so that it stays when a task runs again, and
    copies are spread like all other rows.
    """
    if unique:
        return df.orderBy(draw_key(seed, keys), *keys)
    numbered = materialize(df.withColumn("__copy", F.monotonically_increasing_id()), "numbered")
    return numbered.orderBy(draw_key(seed, [*keys, "__copy"])).drop("__copy")


def union_with_synthetic(gold: DataFrame | None, synthetic: DataFrame | None, spark=None) -> DataFrame:
    """Gold and synthetic rows under one schema; columns a side lacks are null."""
    if gold is None and synthetic is None:
        if spark is None:
            raise ValueError("a session is needed when both sides are absent")
        return spark.createDataFrame([], CORPUS_SCHEMA)
    if gold is None or synthetic is None:
        return gold if synthetic is None else synthetic
    return gold.unionByName(synthetic, allowMissingColumns=True)
