"""Arrow batches in tasks: new columns beside untouched ones, words as numbers, ragged arrays.

Every operator that runs Python goes through :func:`append_columns` or ``mapInArrow``; memory
in a task is bounded by a slice of rows (at least one row, else at most ``SLICE_BYTES``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values in ``column`` hold at most ``limit`` bytes together."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    upto = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def as_bytes(column: pa.Array) -> list[bytes]:
    """Values of a string or binary column; null becomes empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def values_of(pieces: pa.StringArray) -> list[bytes]:
    """The values of a column without nulls and blanks: all as one, then cut, not a scalar for each."""
    if not len(pieces):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return pc.binary_join(whole, " ")[0].as_buffer().to_pybytes().split(b" ")


def chunks(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Pieces of texts between ASCII white space: (number of each piece, pieces per text, distinct pieces).

    Null counts as empty; ``lower`` makes A-Z small.
    """
    texts = pc.fill_null(column.cast(pa.binary()), b"").view(pa.string())
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
    pieces = found.flatten().dictionary_encode()
    numbers, names = pieces.indices.to_numpy(zero_copy_only=False), pieces.dictionary
    distinct = values_of(names)
    empty = pc.index(names, "").as_py()  # white space at an end of a text leaves an empty piece there
    if empty >= 0:
        gone = numbers == empty
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[gone], minlength=len(sizes))
        numbers = numbers[~gone]
        numbers = numbers - (numbers > empty)
        del distinct[empty]
    return numbers, sizes, distinct


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` with the columns that a function of Arrow arrays computes from ``inputs``.

    ``make()`` runs once per task and returns the function.  Columns of ``df`` pass through as
    they are; one that has the name of a new column is replaced.
    """
    new = {f.name for f in fields}
    kept = [c for c in df.columns if c not in new]
    n = len(kept)
    # An input that passes through travels once.
    more = [c for c in dict.fromkeys(inputs) if c not in kept]
    at = [([*kept, *more]).index(c) for c in inputs]
    wide = df.select(
        *[F.col(f"`{c}`") for c in kept],
        *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(more)],
    )
    schema = T.StructType([*wide.schema.fields[:n], *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            # The first input decides the slices, so it has to be text or binary.
            for part in slices(batch, at[0], limit):
                work = work or make()
                made = work([part.columns[i] for i in at])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=names)

    return wide.mapInArrow(run, schema)


def numbering() -> defaultdict:
    """A table that gives each new key the next number when it is looked up."""
    table: defaultdict = defaultdict()
    table.default_factory = table.__len__
    return table


def numbered(table: defaultdict, items: list) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, items), np.int64, len(items))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of ragged parts: n + 1 values from 0."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The parts ``flat[begins[i] : begins[i] + lengths[i]]`` one after another."""
    out = starts_of(lengths)
    return flat[np.repeat(begins - out[:-1], lengths) + np.arange(out[-1])]


class PieceCache:
    """Encodes lists of items, such as the chunks of texts, by way of their distinct items.

    ``encode(items)`` returns (flat ids, ids per item) and must not depend on neighbours.
    Results are kept over batches in the worker; past ``limit`` items the store starts anew,
    so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit=250_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.table = numbering()
        self.flat = np.zeros(1 << 16, np.int32)
        self.begins = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, chunks: list[bytes], at: int) -> None:
        ids, counts = self.encode(chunks)
        end = at + len(chunks)
        if end > len(self.begins):
            room = max(end, 2 * len(self.begins))
            self.begins = np.resize(self.begins, room)
            self.counts = np.resize(self.counts, room)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + len(ids), 2 * len(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.counts[at:end] = counts
        self.begins[at:end] = self.used + starts_of(counts)[:-1]
        self.used += len(ids)

    def texts(self, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all texts, ids per text); items are the chunks between ASCII white space."""
        return self.of(*self.cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())))

    def cut(self, texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the chunks of all texts, chunks per text); they hold until the next call."""
        if len(self.table) > self.limit:
            self.clear()
        known = len(self.table)
        found, sizes, items = chunks(texts, lower)
        numbers = numbered(self.table, items)
        if len(self.table) > known:
            self._add(list(islice(self.table, known, None)), known)
        return numbers[found], sizes

    def lists(self, lists: Iterable[list]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all lists, ids per list)."""
        return self.of(*self.numbers(lists))

    def numbers(self, lists: Iterable[list]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all items, items per list); they hold until the next call."""
        if len(self.table) > self.limit:
            self.clear()
        known = len(self.table)
        sizes = []

        def measured():
            for items in lists:
                sizes.append(len(items))
                yield items

        # One pass over all items: lists are short and many where chunks are cut into words.
        flow = chain.from_iterable(measured())
        words = np.fromiter(map(self.table.__getitem__, flow), np.int64)
        if len(self.table) > known:
            self._add(list(islice(self.table, known, None)), known)
        return words, np.array(sizes, np.int64)

    def of(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all lists, ids per list) of what :meth:`numbers` gave."""
        counts = self.counts[words]
        total = starts_of(counts)
        return gather(self.flat, self.begins[words], counts), np.diff(total[starts_of(sizes)])
