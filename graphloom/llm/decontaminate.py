"""Benchmark decontamination over whole texts.

The benchmark's items become windows of ``size`` normalised words (a shorter item is one window
of its own length).  Their hashes are broadcast in chunks of at most ``chunk_windows`` windows;
more chunks mean more passes over the rows of the same task, in memory and without a shuffle,
so neither side is ever cut.  A task hashes all windows of its texts, looks them up, verifies
the hits word by word, and keeps the hit words and the items.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.batches import append_columns, as_bytes, numbered, numbering, starts_of

WINDOW = 13
CHUNK_WINDOWS = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
# Bytes outside words become blanks; A-Z become lower case; all bytes above 0x7F are in words.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive codes of a flat array."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _MUL + codes[k : k + n]
    return mixed(out)


def word_codes(words: list[bytes]) -> np.ndarray:
    """64-bit codes that depend on the word alone, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


class Windows:
    """Hash set of benchmark windows by length, with the words to verify a hit and its items."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list]]):
        by_size: dict = defaultdict(list)
        for words, items in windows:
            by_size[len(words)].append((words, items))
        self.sizes = {}
        for size, found in sorted(by_size.items()):
            hashes = np.array(
                [window_hashes(word_codes(list(w)), size)[0] for w, _ in found], np.uint64
            )
            order = np.argsort(hashes, kind="stable")
            self.sizes[size] = (hashes[order], [found[i] for i in order])

    def scan(self, texts: list[bytes]):
        """For each text: word count, hit word positions, items of verified windows."""
        table = numbering()
        split = [words_of(t) for t in texts]
        parts = [numbered(table, w) for w in split]
        bounds = starts_of(np.fromiter(map(len, parts), np.int64, len(parts)))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        codes = word_codes(list(table))[flat] if len(table) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(parts)), np.diff(bounds))
        hit = np.zeros(len(flat), bool)
        items: list[set] = [set() for _ in parts]
        for size, (hashes, found) in self.sizes.items():
            rolled = window_hashes(codes, size)
            if not len(rolled):
                continue
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            inside = owner[: len(rolled)] == owner[size - 1 :]
            for begin in np.flatnonzero((hashes[at] == rolled) & inside).tolist():
                text = int(owner[begin])
                first = begin - int(bounds[text])
                here = tuple(split[text][first : first + size])
                slot = int(at[begin])
                while slot < len(hashes) and hashes[slot] == rolled[begin]:
                    if found[slot][0] == here:
                        hit[begin : begin + size] = True
                        items[text].update(found[slot][1])
                    slot += 1
        positions = np.flatnonzero(hit)
        per_text = np.bincount(owner[positions], minlength=len(parts)) if len(parts) else []
        return np.diff(bounds), positions - bounds[owner[positions]], per_text, items


def item_windows(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """``words binary, items array``: one row per distinct window of the benchmark; ids keep their type."""
    kind = benchmark.select(F.col(item_id).alias("item")).schema["item"].dataType

    def cut(batches):
        for batch in batches:
            words, ids = [], []
            for item, value in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                found = words_of(value)
                for i in range(max(1, len(found) - size + 1) if found else 0):
                    words.append(b" ".join(found[i : i + size]))
                    ids.append(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(ids, to_arrow_type(kind))], names=["words", "item"]
            )

    rows = benchmark.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("item", kind)])
    windows = rows.filter("item IS NOT NULL").mapInArrow(cut, schema)
    return windows.groupBy("words").agg(F.collect_set("item").alias("items"))


def scan_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    chunk_windows: int = CHUNK_WINDOWS,
) -> DataFrame:
    """Append ``n_words long, hit_words array<long>, items`` (an array of ids) to each document.

    ``hit_words`` are the positions of words inside any occurrence of a window, ascending;
    ``items`` the ids of items with such windows, ascending.  Null or wordless texts have no
    words and no hits; items without words or id have no windows; an empty benchmark hits
    nothing.  Repeated rows are judged alike.  Columns with the new names are replaced.
    """
    windows = item_windows(benchmark, item_id, item_text, size).cache()
    chunks = -(-windows.count() // chunk_windows)
    kind = windows.schema["items"].dataType.elementType
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(kind)),
    ]
    context = docs.sparkSession.sparkContext
    out = docs
    for chunk in range(max(1, chunks)):
        part = windows.filter(F.abs(F.xxhash64("words") % F.lit(max(1, chunks))) == chunk)
        # About ``chunk_windows`` rows by the choice of the number of chunks.
        rows = [(tuple(r["words"].split(b" ")), list(r["items"])) for r in part.toLocalIterator()]
        rows = [(tuple(map(bytes, w)), i) for w, i in rows]
        shared = context.broadcast(rows)
        first = chunk == 0

        def make(shared=shared, first=first):
            windows = Windows(shared.value)

            def work(columns):
                counts, positions, per_text, items = windows.scan(as_bytes(columns[0]))
                bounds = starts_of(np.asarray(per_text, np.int64))
                hits = [positions[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                if not first:
                    hits = [
                        np.union1d(h, np.array(old, np.int64))
                        for h, old in zip(hits, columns[1].to_pylist(), strict=True)
                    ]
                    items = [s | set(old) for s, old in zip(items, columns[2].to_pylist(), strict=True)]
                return [
                    pa.array(counts, pa.int64()),
                    pa.array(hits, pa.list_(pa.int64())),
                    pa.array([sorted(s) for s in items], pa.list_(to_arrow_type(kind))),
                ]

            return work

        out = append_columns(out, [text] if first else [text, "hit_words", "items"], fields, make)
    return out


def is_contaminated(hits: Column, words: Column) -> Column:
    """The contract's rule: some hit, and hits are at least a twentieth of the words."""
    return (hits > 0) & (hits * 20 >= words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = own.select("row", F.col(f"row.`{text}`").alias("__text"))
    seen = scan_benchmark(own, benchmark, "__text")
    keep = ~is_contaminated(F.size("hit_words"), F.col("n_words"))
    return seen.filter(keep).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose hit words are cut out: each run of hit words, with what stands between
    them, becomes one blank.  Other text stays as it is."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = own.select("row", F.col(f"row.`{text}`").alias("__text"))
    seen = scan_benchmark(own, benchmark, "__text")

    def make():
        def cut(raw: bytes, hits: list[int]) -> str | None:
            plain = np.frombuffer(raw.translate(_TO_WORDS), np.uint8) != 0x20
            edge = np.diff(np.concatenate([[0], plain.view(np.int8), [0]]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            at = np.array(hits, np.int64)
            fresh = np.diff(at, prepend=-2) != 1
            out, last = [], 0
            for a, b in zip(at[fresh], at[np.append(fresh[1:], True)], strict=True):
                out.append(raw[last : begin[a]])
                last = end[b]
            return b" ".join([*out, raw[last:]]).decode()

        def work(columns):
            texts = columns[0].to_pylist()
            return [
                pa.array(
                    [
                        cut(t.encode(), h) if h else t
                        for t, h in zip(texts, columns[1].to_pylist(), strict=True)
                    ],
                    pa.string(),
                )
            ]

        return work

    field = [T.StructField("__cut", T.StringType())]
    cut = append_columns(seen, ["__text", "hit_words"], field, make)
    return cut.select(
        *[(F.col("__cut") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )
