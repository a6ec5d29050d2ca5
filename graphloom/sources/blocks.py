"""Annotated graph block files.

    # ::id t_1.1 ::date 2020-01-01
    # ::snt The boy wants to go.
    (w / want-01
       :ARG0 (b / boy))

A file is read in blocks by many tasks.  What a line inherits from earlier lines of its
file (id, sentence, whether a graph is being read) is carried from block to block through
one summary row per block, so no file has to fit into a task.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.constants import SPLITS
from graphloom.functions.text import metadata_id, metadata_sentence, strip_unicode
from graphloom.operators.indexing import read_lines
from graphloom.operators.validate import checked_broadcast
from graphloom.session import materialize

# The walks run in tasks, so that executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_graph_blocks(
    spark: SparkSession,
    paths: str | list[str],
    *,
    keep_unterminated: bool = False,
    reset_fields: bool = False,
) -> DataFrame:
    """``id, sentence, amr_graph, source_file, pos`` of every record.

    A record ends at a blank line after a graph; a last graph without one is left out
    unless ``keep_unterminated``.  A record without its own id or sentence takes over the
    file's previous one, or null with ``reset_fields``.  Graphs that follow each other
    under one sentence add up: the second record holds both.  A sentence line inside a
    graph drops the lines before it, so the record may be left with an empty graph.

    The files are read twice: first for one row per block, which is written and broadcast after a check
    of its size.  Only what stands under the first and the last sentence of a block is shuffled.
    """
    lines = _classified(read_lines(spark, paths))
    # One row per file block here, never one per line.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = _summaries(lines).select(
        "file",
        "block",
        F.last("last_id", ignorenulls=True).over(earlier).alias("from_id"),
        F.last("last_snt", ignorenulls=True).over(earlier).alias("from_snt"),
        F.last("last_turn", ignorenulls=True).over(earlier).alias("from_reading"),
        F.coalesce(F.sum("all_snt").over(earlier), F.lit(0)).alias("from_n_snt"),
        F.coalesce(F.sum("all_blank").over(earlier), F.lit(0)).alias("from_n_blank"),
    )
    carried = checked_broadcast(materialize(carried, "block-states"))
    known = _runs(lines, reset_fields).join(carried, ["file", "block"]).select(
        "file",
        "block",
        "first",
        "whole",
        "kept",
        "lines",
        "ended",
        F.coalesce("reading", "from_reading", F.lit(False)).alias("reading"),
        F.struct(
            F.coalesce("id", "from_id").alias("id"), F.coalesce("snt", "from_snt").alias("sentence")
        ).alias("latest"),
        (F.col("from_n_snt") + F.col("n_snt")).alias("snt_no"),
        (F.col("from_n_blank") + F.col("n_blank")).alias("pos"),
        "id_at",
        F.coalesce("own_id", "from_id").alias("own_id"),
        "snt_at",
        F.coalesce("own_snt", "from_snt").alias("own_snt"),
    )
    kept = known.filter(F.col("kept") & F.col("reading"))
    done = kept.filter("whole").select("file", "pos", "lines", "ended", "latest")
    at = F.struct("block", "first")
    groups = (
        kept.filter(~F.col("whole"))
        # Records under one sentence are put together again below: one shuffle serves both.
        .repartition("file", "snt_no")
        .groupBy("file", "snt_no", "pos")
        .agg(
            F.array_sort(F.collect_list(F.struct("block", "first", "lines"))).alias("parts"),
            F.max("ended").alias("ended"),
            F.max_by("latest", at).alias("latest"),
        )
        .withColumn("lines", F.flatten(F.transform("parts", lambda x: x["lines"])))
    )
    under_sentence = Window.partitionBy("file", "snt_no").orderBy("pos")
    all_lines = F.flatten(
        F.collect_list("lines").over(under_sentence.rowsBetween(Window.unboundedPreceding, 0))
    )
    loose = groups.select("file", "pos", all_lines.alias("lines"), "ended", "latest")
    whole = done.unionByName(loose)
    if not keep_unterminated:
        whole = whole.filter("ended")
    records = whole.select(
        F.col("latest.id").alias("id"),
        F.col("latest.sentence").alias("sentence"),
        strip_unicode(F.array_join("lines", "\n")).alias("amr_graph"),
        F.col("file").alias("source_file"),
        "pos",
    )
    if not reset_fields:
        return records
    own = known.groupBy(F.col("file").alias("source_file"), "pos").agg(
        F.max_by("own_id", F.when(F.col("id_at").isNotNull(), F.struct("block", "id_at"))).alias("own_id"),
        F.max_by("own_snt", F.when(F.col("snt_at").isNotNull(), F.struct("block", "snt_at"))).alias("own_sentence"),
    )
    return records.join(own, ["source_file", "pos"], "left").select(
        F.col("own_id").alias("id"), F.col("own_sentence").alias("sentence"),
        "amr_graph", "source_file", "pos",
    )


_SUMMARY = (
    "file string, block long, last_id string, last_snt string, last_turn boolean, all_snt long, all_blank long"
)


def _pieces(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """Parts of a batch that lie in one block of one file each."""
    file, block = batch.column("file"), batch.column("block")
    n = len(file)
    other = pc.or_(pc.not_equal(file[1:], file[: n - 1]), pc.not_equal(block[1:], block[: n - 1]))
    cuts = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    return [batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False)] if n else []


def _is(rows: pa.RecordBatch, kind: str) -> np.ndarray:
    return pc.equal(rows.column("kind"), kind).to_numpy(zero_copy_only=False)


def _latest(known: np.ndarray) -> np.ndarray:
    """For each place the last one up to it where ``known`` holds, else -1."""
    return np.maximum.accumulate(np.where(known, np.arange(len(known)), -1))


def _summaries(lines: DataFrame) -> DataFrame:
    """What a block leaves to the later ones of its file: one row per block.

    A task reads the lines of a block one after another, so nothing is sorted.
    """
    schema = to_arrow_schema(T._parse_datatype_string(_SUMMARY))

    def walk(batches):
        at, state = None, None
        for batch in batches:
            for rows in _pieces(batch):
                where = (rows.column("file")[0].as_py(), rows.column("block")[0].as_py())
                if where != at:
                    if state is not None:
                        yield pa.RecordBatch.from_pylist([state], schema=schema)
                    at, state = where, {"file": where[0], "block": where[1], "all_snt": 0, "all_blank": 0}
                blank, opened = _is(rows, "blank"), _is(rows, "open")
                state["all_blank"] += int(blank.sum())
                state["all_snt"] += int(_is(rows, "snt").sum())
                turn = _latest(blank | opened)[-1]
                if turn >= 0:
                    state["last_turn"] = bool(opened[turn])
                for name in ("id", "snt"):
                    told = rows.column(name).drop_null()
                    if len(told):
                        state[f"last_{name}"] = told[-1].as_py()
        if state is not None:
            yield pa.RecordBatch.from_pylist([state], schema=schema)

    return lines.select("file", "block", "kind", "id", "snt").mapInArrow(walk, _SUMMARY)


_HELD = 100_000  # lines that a task adds up under one sentence; where there are more, a shuffle does it
_RUN = (
    "file string, block long, n_snt long, n_blank long, first long, whole boolean, reading boolean, "
    "kept boolean, ended boolean, lines array<string>, id string, snt string, "
    "id_at long, own_id string, snt_at long, own_snt string"
)


def _runs(lines: DataFrame, own: bool) -> DataFrame:
    """Lines of graphs, put together as far as a block tells: one row for those between two blank or
    sentence lines, numbered by the sentence and blank lines before them in the block.

    ``reading`` is null where only the blocks before can tell whether the lines belong to a graph.  A run is
    ``whole`` if its sentence begins and ends in the block: it then holds the lines of all earlier runs under
    the sentence.  With ``own`` there is a row for each line of metadata as well, with what it tells.
    """
    schema = to_arrow_schema(T._parse_datatype_string(_RUN))
    limit = _HELD

    def table(n, state, values):
        values = {"file": pa.repeat(state["file"], n), "block": pa.repeat(state["block"], n), **values}
        columns = [values[f.name].cast(f.type) if f.name in values else pa.nulls(n, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def give(rows, state, closed):
        """Runs of lines that follow each other; ``closed`` if the last sentence ends with them."""
        n = rows.num_rows
        is_snt, is_open, is_blank = (_is(rows, k) for k in ("snt", "open", "blank"))
        n_snt = state["n_snt"] + np.cumsum(is_snt)
        n_blank = state["n_blank"] + np.cumsum(is_blank) - is_blank
        turn = _latest(is_open | is_blank)
        before = np.append(-1, turn[:-1])
        reading = np.where(before >= 0, is_open[before], state["reading"])  # -1 where not known
        sure = is_open | (reading == 1)
        place = rows.column("place").to_numpy()

        def filled(name, at):
            found = _latest(rows.column(name).is_valid().to_numpy(zero_copy_only=False))[at]
            told = rows.column(name).take(pa.array(found, mask=found < 0))
            return told if state[name] is None else pc.fill_null(told, state[name])

        kept = np.flatnonzero(is_open | ((_is(rows, "text") | is_blank) & (reading != 0)))
        if len(kept):
            keys = np.stack([n_snt[kept], n_blank[kept], sure[kept]])
            begin = np.flatnonzero(np.append(True, (np.diff(keys) != 0).any(axis=0)))
            end = np.append(begin[1:], len(kept))
            # Runs under one sentence stand side by side.
            snt = keys[0][begin]
            new = np.append(True, np.diff(snt) != 0)
            group = np.cumsum(new) - 1
            is_line = ~is_blank[kept]
            upto = np.append(0, np.cumsum(is_line))
            size = np.bincount(group, upto[end] - upto[begin])
            whole = (np.bincount(group, keys[2][begin] == 0) == 0) & (np.bincount(group) * size <= limit)
            whole &= snt[new] != state["n_snt"]
            if not closed:
                whole &= snt[new] != n_snt[-1]
            whole = whole[group]
            start = upto[np.where(whole, begin[np.flatnonzero(new)[group]], begin)]
            length = upto[end] - start
            offsets = np.append(0, np.cumsum(length))
            places = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
            shown = rows.column("line").take(pa.array(kept[is_line][places]))
            last = kept[end - 1]
            yield table(len(begin), state, {
                "n_snt": pa.array(snt), "n_blank": pa.array(keys[1][begin]), "first": pa.array(place[kept[begin]]),
                "whole": pa.array(whole), "reading": pa.array(np.ones(len(begin), bool), mask=keys[2][begin] == 0),
                "kept": pa.repeat(True, len(begin)), "ended": pa.array(is_blank[last]),
                "lines": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), shown),
                "id": filled("id", last), "snt": filled("snt", last),
            })
        for name, told in (("id", _is(rows, "id")), ("snt", is_snt)) if own else ():
            at = np.flatnonzero(told)
            yield table(len(at), state, {
                "n_snt": pa.array(n_snt[at]), "n_blank": pa.array(n_blank[at]), "whole": pa.repeat(False, len(at)),
                "kept": pa.repeat(False, len(at)), f"{name}_at": pa.array(place[at]), f"own_{name}": filled(name, at),
            })
        for name in ("id", "snt"):
            state[name] = filled(name, np.array([n - 1]))[0].as_py()
        state.update(n_snt=int(n_snt[-1]), n_blank=int(n_blank[-1] + is_blank[-1]))
        if turn[-1] >= 0:
            state["reading"] = int(is_open[turn[-1]])

    def walk(batches):
        at, held, state = None, None, None
        for batch in batches:
            for rows in _pieces(batch):
                where = (rows.column("file")[0].as_py(), rows.column("block")[0].as_py())
                if where != at:
                    if held is not None:
                        yield from give(held, state, False)
                    at, held = where, None
                    state = {"file": where[0], "block": where[1], "n_snt": 0, "n_blank": 0, "reading": -1,
                             "id": None, "snt": None}
                if held is not None:
                    rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                # The last sentence may go on: it waits for the next lines.
                cut = max(np.flatnonzero(_is(rows, "snt")), default=0)
                if cut:
                    yield from give(rows.slice(0, cut), state, True)
                held = rows.slice(cut)
                if held.num_rows > limit:
                    yield from give(held, state, False)
                    held = None
        if held is not None:
            yield from give(held, state, False)

    return lines.select("file", "block", "place", "line", "kind", "id", "snt").mapInArrow(walk, _RUN)


def _classified(lines: DataFrame) -> DataFrame:
    """Kind of each line; tests run in this order: id, sentence, opening, blank, text."""
    line = F.col("line")
    kind = (
        F.when(line.contains("# ::id"), "id")
        .when(line.contains("# ::snt"), "snt")
        .when(line.startswith("("), "open")
        .when(strip_unicode(line) == "", "blank")
        .otherwise("text")
    )
    out = lines.withColumn("kind", kind)
    is_kind = lambda k: F.col("kind") == k
    return out.withColumns(
        {
            "id": F.when(is_kind("id"), metadata_id("line")),
            "snt": F.when(is_kind("snt"), metadata_sentence("line")),
        }
    )


def read_graph_blocks_by_paragraph(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The fast reader: ``id, sentence, amr_graph, source_file`` without any shuffle.

    Splits files at empty lines (``\\n\\n``) and reads every paragraph by itself, so it is
    for files in which each record is complete: nothing is carried from one paragraph to
    the next, a last record counts without a blank line behind it, and lines that hold
    only blanks separate nothing.
    """
    block = F.col("value")
    rows = F.split(block, r"\r\n|\r|\n")
    ids = F.filter(rows, lambda x: x.contains("# ::id"))
    sentences = F.filter(rows, lambda x: x.contains("# ::snt") & ~x.contains("# ::id"))
    graph = F.regexp_extract(block, r"(?ms)^\(.*", 0)
    graph_rows = F.filter(
        F.split(graph, r"\r\n|\r|\n"), lambda x: ~x.contains("# ::id") & ~x.contains("# ::snt")
    )
    return (
        spark.read.option("lineSep", "\n\n")
        .text(paths)
        .select(
            metadata_id(F.try_element_at(ids, F.lit(-1))).alias("id"),
            metadata_sentence(F.try_element_at(sentences, F.lit(-1))).alias("sentence"),
            strip_unicode(F.array_join(graph_rows, "\n")).alias("amr_graph"),
            F.col("_metadata.file_path").alias("source_file"),
        )
        .filter(F.col("amr_graph") != "")
    )


def read_split_folders(
    spark: SparkSession, folder: str, splits: tuple[str, ...] = SPLITS, **options
) -> DataFrame:
    """Records of all split folders with ``split`` and a row order: split, file, place."""
    records = read_graph_blocks(spark, [f"{folder.rstrip('/')}/{s}" for s in splits], **options)
    name = F.element_at(F.split("source_file", "/"), -2)
    rank = F.array_position(F.array(*[F.lit(s) for s in splits]), name) - 1
    return records.withColumns({"split": name, "split_order": rank})
