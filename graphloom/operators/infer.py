"""Batched model calls over a column.  The model is a callable the user brings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.constants import BATCH_SIZE
from graphloom.functions.text import as_column, attention_mask, mask_label_padding, pad_or_truncate

Model = Callable[[list], Sequence]
ROWS_HELD = 256  # rows, or one batch of the model, whose inputs and outputs are Python values at a time
KEPT_MODELS = 4  # models that a Python worker keeps, so that old ones do not fill it


def batch_infer(
    df: DataFrame,
    load_model: Callable[[], Model],
    inputs: str | Sequence[str],
    output: str,
    *,
    output_type: str = "string",
    batch_size: int = BATCH_SIZE,
    by_length: bool = False,
) -> DataFrame:
    """Add the model's output for every row; all input columns stay next to it.

    ``load_model`` is called once per Python worker, whose tasks share the model, and gives a
    function from a list of inputs to as many outputs.  With several input columns an input is a dict
    of their values.  Batches have ``batch_size`` rows but for a task's last one, whatever the Arrow
    batches; with ``by_length`` inputs of like length are put in one batch, among the rows of an
    Arrow batch, and the rows come out in their old order.  Only the inputs become Python values;
    other columns stay Arrow data and keep every value.
    """
    single = isinstance(inputs, str)
    names = [inputs] if single else list(inputs)
    schema = T.StructType(
        [*df.schema.fields, T.StructField(output, T._parse_datatype_string(output_type))]
    )
    made_type = to_arrow_type(schema.fields[-1].dataType)
    key = hashlib.sha256(cloudpickle.dumps(load_model)).hexdigest()
    step = batch_size * max(1, ROWS_HELD // batch_size)

    def worker_model() -> Model:
        # Workers live on over tasks and micro-batches.  The latest models stay in a module of the
        # worker's own, so that executors need no installed package.
        import sys
        import types

        store = sys.modules.setdefault("_worker_models", types.ModuleType("_worker_models"))
        models = store.__dict__.setdefault("models", {})
        model = models.pop(key) if key in models else load_model()
        models[key] = model  # the latest stands last
        while len(models) > KEPT_MODELS:
            models.pop(next(iter(models)))
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model()

        def size(value) -> int:
            return sum(len(str(v)) for v in value.values()) if isinstance(value, dict) else len(str(value))

        def given(rows: pa.Table) -> list:
            columns = [rows.column(n).to_pylist() for n in names]
            return columns[0] if single else [dict(zip(names, v)) for v in zip(*columns)]

        def called(values: list) -> list:
            made = list(model(values))
            if len(made) != len(values):
                raise ValueError(f"model gave {len(made)} outputs for {len(values)} inputs")
            return made

        def answer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            # Inputs are Python values for some rows at a time only, whatever an Arrow batch holds.
            parts = [rows.slice(i, step) for i in range(0, rows.num_rows, step)]
            if by_length:
                lengths = [size(v) for part in parts for v in given(part)]
                order = sorted(range(rows.num_rows), key=lengths.__getitem__)
                out = [None] * len(order)
                for start in range(0, len(order), batch_size):
                    places = order[start : start + batch_size]
                    for i, value in zip(places, called(given(rows.take(pa.array(places, pa.int64()))))):
                        out[i] = value
                yield from rows.append_column(output, pa.array(out, made_type)).combine_chunks().to_batches()
                return
            for part in parts:
                values, out = given(part), []
                for start in range(0, len(values), batch_size):
                    out += called(values[start : start + batch_size])
                yield from part.append_column(output, pa.array(out, made_type)).combine_chunks().to_batches()

        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None or not held.num_rows else pa.concat_tables([held, new])
            whole = held.num_rows - held.num_rows % batch_size
            if whole:
                yield from answer(held.slice(0, whole))
                # A copy of the few rows left, so that the Arrow batch they came in can go.
                held = held.take(pa.array(range(whole, held.num_rows), pa.int64()))
            del batch, new
        if held is not None and held.num_rows:
            yield from answer(held)

    return df.mapInArrow(run, schema)


def score_translations(
    pairs: DataFrame,
    load_scorer: Callable[[], Model],
    *,
    source: str = "sentence",
    translation: str = "hu_sentence",
    output: str = "score",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Quality score of every pair; the scorer sees dicts with ``src`` and ``mt``."""
    named = pairs.withColumnsRenamed({source: "src", translation: "mt"})
    return batch_infer(
        named, load_scorer, ["src", "mt"], output, output_type="double", batch_size=batch_size
    )


def tokenize(text: Column | str, load_tokenizer: Callable[[], Callable[[str], list]]) -> Column:
    """Token ids by a user's tokenizer, in Arrow batches, loaded once per task."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load_tokenizer()
        for batch in batches:
            yield batch.map(lambda s: None if s is None else list(tokenizer(s)))

    return encode(as_column(text))


def seq2seq_inputs(
    df: DataFrame,
    input_ids: str,
    label_ids: str | None,
    *,
    max_input: int,
    max_output: int,
    pad_id: int = 0,
) -> DataFrame:
    """``input_ids``, ``attention_mask`` and ``labels`` of fixed length; label padding is
    -100.  Without label ids (inference) there is no ``labels`` column."""
    made = {
        "input_ids": pad_or_truncate(input_ids, max_input, pad_id),
        "attention_mask": attention_mask(input_ids, max_input),
    }
    if label_ids is not None:
        made["labels"] = mask_label_padding(pad_or_truncate(label_ids, max_output, pad_id), pad_id)
    return df.withColumns(made)
