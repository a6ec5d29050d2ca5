"""Sentence ends with abbreviations learned from the corpus itself.

A word is counted with and without a full stop behind it over all texts.  An abbreviation has its
full stop much more often than words have one, by a likelihood ratio, and mostly in front of a word
in lower case.  Splitting is a native fold over the pieces between possible sentence ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import as_column, clean_sentence

# Alike in Java regex and RE2, so another engine can check the counts.
_BEFORE, _BEHIND = r"^[^\p{L}\p{N}]+", r"[^\p{L}\p{N}.]+$"
_PIECE = r"[^.!?\n]+[.!?]*\n?|[.!?]+\n?"
LEAST_SCORE = 10.83  # chance of one in a thousand that a word's full stops are by chance
MOST = 5_000  # words that splitting takes along, the strongest first


def abbreviation_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``word, n, n_dot, n_inside, score``: how often a word stands, with a full stop behind it, and
    with one in front of a word in lower case; ``score`` is the log-likelihood ratio of its full stops
    against those of all words, 0 where it has fewer than its share.

    Words are lower-case tokens between blanks without other marks around them.  Counts are
    combined before the shuffle.  Null texts have no words.
    """
    tokens = F.split(F.col(f"`{text}`"), r"\s+")
    each = df.select(tokens.alias("__tokens")).select("__tokens", F.posexplode("__tokens").alias("i", "token"))
    bare = F.lower(F.regexp_replace(F.regexp_replace("token", _BEFORE, ""), _BEHIND, ""))
    seen = each.select(
        F.regexp_replace(bare, r"\.+$", "").alias("word"),
        bare.endswith(".").alias("dot"),
        F.coalesce(F.get("__tokens", F.col("i") + 1).rlike(r"^\p{Ll}"), F.lit(False)).alias("inside"),
    ).filter("word <> ''")
    counts = seen.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("dot").alias("n_dot"),
        F.count_if(F.col("dot") & F.col("inside")).alias("n_inside"),
    )
    total = seen.agg(F.count(F.lit(1)).alias("all_n"), F.count_if("dot").alias("all_dot"))
    own, share = F.col("n_dot") / F.col("n"), F.col("all_dot") / F.col("all_n")
    term = lambda k, p, q: F.when(k > 0, k * F.ln(p / q)).otherwise(0.0)
    ratio = 2 * (term(F.col("n_dot"), own, share) + term(F.col("n") - F.col("n_dot"), 1 - own, 1 - share))
    # One row of totals beside the counts.
    scored = counts.join(F.broadcast(total), F.lit(True))
    return scored.select("word", "n", "n_dot", "n_inside", F.when(own > share, ratio).otherwise(0.0).alias("score"))


def learned_abbreviations(counts: DataFrame, least_score: float = LEAST_SCORE, most: int = MOST) -> list[str]:
    """The abbreviations of :func:`abbreviation_counts`: a full stop in more than half of their uses,
    half of these in front of lower case, and no chance score.  At most ``most``, the strongest
    first; a language has some hundred."""
    sure = counts.filter(
        (F.col("score") >= least_score) & (F.col("n_dot") * 2 > F.col("n")) & (F.col("n_inside") * 2 >= F.col("n_dot"))
    )
    return [r["word"] for r in sure.orderBy(F.desc("score"), "word").limit(most).collect()]


def split_by_abbreviations(text: Column | str, abbreviations: Sequence[str], clean: bool = True) -> Column:
    """Array of sentences: as the plain rule, but a full stop inside a token or behind one of the
    abbreviations ends none.  Blanks are trimmed and empty sentences dropped; null gives null."""
    known = F.array(*map(F.lit, abbreviations)) if abbreviations else F.array().cast("array<string>")
    pieces = F.regexp_extract_all(as_column(text), F.lit(_PIECE), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, piece: Column) -> Column:
        last = F.lower(F.regexp_replace(F.element_at(F.split(state["open"], r"\s"), -1), _BEFORE, ""))
        stop = state["open"].endswith(".")
        goes_on = (state["open"] == "") | (
            stop & (~piece.rlike(r"^[\s]") | F.array_contains(known, F.regexp_replace(last, r"\.+$", "")))
        )
        return F.when(
            goes_on, F.struct(state["done"].alias("done"), F.concat(state["open"], piece).alias("open"))
        ).otherwise(F.struct(F.array_append(state["done"], state["open"]).alias("done"), piece.alias("open")))

    found = F.aggregate(pieces, start, step, lambda s: F.array_append(s["done"], s["open"]))
    found = F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"\s+$", ""))), lambda s: s != "")
    return F.transform(found, clean_sentence) if clean else found
