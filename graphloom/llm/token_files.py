"""Token-id files: blocks coded by a range asymmetric numeral system.

A folder holds three tables written by Spark, so any store that Spark reaches can hold it:

* ``table``  - ``symbol, frequency``: the frequency table all blocks share;
* ``blocks`` - one row per block: ``shard``, ``block``, ``start`` (ids before it in its shard),
  ``doc_ids`` and ``lengths`` of its documents, the coder's ``lanes``, ``words``, checkpoint
  ``states`` and ``offsets``, and ``crc`` over the ids of the block;
* ``shards`` - ``shard, before``: ids in all earlier shards.

Blocks are independent, hold whole documents, and close at ``BLOCK_IDS`` ids; shards follow one
another in ascending document order.  A document with more ids is a block of its own.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import rans
from graphloom.llm.batches import PieceCache, append_columns, slices, starts_of
from graphloom.llm.bpe import chunk_cache, kept, read_vocabulary
from graphloom.session import fresh_path, materialize

BLOCK_IDS = 1 << 18
LINE = 256
_BLOCK = (
    "shard int, block int, start long, doc_ids array<long>, lengths array<long>, lanes int, "
    "words binary, states binary, offsets array<long>, crc long"
)


def library_cache(data: bytes) -> PieceCache:
    """A store of chunks whose words the ``tokenizers`` library encodes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()

    last = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)  # ids that end a word
    for token, i in tokenizer.get_vocab().items():
        last[i] = token.endswith("</w>")

    def one_by_one(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts

    def encode(items: list) -> tuple[np.ndarray, np.ndarray]:
        """Words go to the library as lines of ``LINE`` words, since a call costs more than a word; where a line
        has not as many word ends as words, and for raw chunks, each goes by itself."""
        parts, sizes = [], []
        for at in range(0, len(items), 16 * LINE):  # the library's own results are large
            lines = [items[i : i + LINE] for i in range(at, min(at + 16 * LINE, len(items)), LINE)]
            texts = [[i if isinstance(i, bytes) else i[0] for i in x] for x in lines]
            made = tokenizer.encode_batch_fast([b" ".join(x).decode() for x in texts], add_special_tokens=False)
            for line, words, encoding in zip(lines, texts, made, strict=True):
                ids = np.array(encoding.ids, np.int32)
                ends = np.flatnonzero(last[ids])
                if all(isinstance(i, bytes) for i in line) and len(ends) == len(words) and ends[-1] == len(ids) - 1:
                    counts = np.diff(ends, prepend=-1)
                else:
                    ids, counts = one_by_one([w.decode() for w in words])
                parts.append(ids)
                sizes.append(counts)
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(parts), np.concatenate(sizes)

    specials = {a["content"]: a["id"] for a in json.loads(data).get("added_tokens", [])}
    return chunk_cache(encode, specials, 450_000, 300_000)


_PACK = pa.Codec("zstd", 1)


def packed(ids: np.ndarray) -> bytes:
    """Ids as a compressed value for tables between two steps: width and size stand in front."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    raw = ids.astype("<u4" if wide else "<u2").tobytes()
    return bytes([wide]) + len(raw).to_bytes(8, "little") + _PACK.compress(raw, asbytes=True)


def unpacked(value: bytes) -> np.ndarray:
    raw = _PACK.decompress(value[9:], int.from_bytes(value[1:9], "little"), asbytes=True)
    return np.frombuffer(raw, "<u4" if value[0] else "<u2")


def tokenize(
    df: DataFrame, path: str, text: str = "text", end_id: int = 1, packed_ids: str = "packed"
) -> DataFrame:
    """Append ``n_ids`` and the compressed ids of ``text`` with ``end_id`` behind them.

    The vocabulary must be one of word ends that drops white space, so that the library needs
    to see each word once per worker, wherever it stands.  Null counts as empty.
    """
    data = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        cache = kept(("library", path), lambda: library_cache(data.value))

        def work(columns):
            flat, counts = cache.texts(columns[0])
            at = starts_of(counts + 1)
            ids, inside = np.full(at[-1], end_id, np.int32), np.ones(at[-1], bool)
            inside[at[1:] - 1] = False
            ids[inside] = flat
            out = [packed(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return [pa.array(counts + 1, pa.int64()), pa.array(out, pa.binary())]

        return work

    fields = [T.StructField("n_ids", T.LongType()), T.StructField(packed_ids, T.BinaryType())]
    return append_columns(df, [text], fields, make)


def id_counts(df: DataFrame, packed_ids: str = "packed") -> DataFrame:
    """``symbol, n`` over all rows: counted per task, then added up."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                ids = np.concatenate([unpacked(v) for v in part.column(0).to_pylist()])
                more = np.bincount(ids)
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["symbol", "n"]
        )

    counted = df.select(packed_ids).mapInArrow(count, "symbol long, n long")
    return counted.groupBy("symbol").agg(F.sum("n").alias("n"))


def write_token_files(df: DataFrame, folder: str, doc_id: str, packed_ids: str = "packed") -> None:
    """Write the rows of :func:`tokenize` to ``folder`` in ascending ``doc_id`` order.

    Rows with the same id stand next to each other, ordered by their ids; null ids come first.
    An empty table gives empty files.
    """
    spark = df.sparkSession
    # One row per symbol of the vocabulary: bounded by its file, not by the data.
    counts = id_counts(df, packed_ids).toPandas()
    size = int(counts["symbol"].max()) + 1 if len(counts) else 1
    dense = np.zeros(size, np.int64)
    dense[counts["symbol"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    freq = rans.scaled(dense)
    rows = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(rows, "symbol long, frequency long").coalesce(1).write.parquet(
        f"{folder}/table"
    )
    shared = spark.sparkContext.broadcast(freq)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shared.value)
        shard = TaskContext.get().partitionId()
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        state = {"block": 0, "start": 0}

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            made = rans.encode(ids, table)
            row = {
                "shard": shard,
                "block": state["block"],
                "start": state["start"],
                "doc_ids": list(docs),
                "lengths": [len(p) for p in parts],
                "lanes": made["lanes"],
                "words": made["words"].astype("<u4").tobytes(),
                "states": made["states"].astype("<u8").tobytes(),
                "offsets": made["offsets"].tolist(),
                "crc": zlib.crc32(ids.astype("<u4").tobytes()),
            }
            state["block"] += 1
            state["start"] += len(ids)
            docs.clear()
            parts.clear()
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        held = 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = unpacked(value)
                if parts and held + len(ids) > BLOCK_IDS:
                    yield close()
                    held = 0
                docs.append(doc)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield close()

    ordered = (
        df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(packed_ids).alias("ids"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "ids")
    )
    ordered.mapInArrow(code, _BLOCK).write.option("compression", "uncompressed").parquet(
        f"{folder}/blocks"
    )
    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", F.expr(_SUM).alias("n"))
    # One row per shard, that is per task of the write above.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).coalesce(
        1
    ).write.parquet(f"{folder}/shards")


_SUM = "aggregate(lengths, 0L, (a, x) -> a + x)"
_BLOCK_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("start", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("lanes", pa.int32()),
        ("words", pa.binary()),
        ("states", pa.binary()),
        ("offsets", pa.list_(pa.int64())),
        ("crc", pa.int64()),
    ]
)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) from the files alone.

    Blocks decode in any order on any executor; a block whose checksum differs raises.
    """
    rows = spark.read.parquet(f"{folder}/table").collect()  # at most one row per vocabulary entry
    freq = np.zeros(max([r.symbol for r in rows], default=0) + 1, np.int64)
    for r in rows:
        freq[r.symbol] = r.frequency
    shared = spark.sparkContext.broadcast(freq)
    shards = spark.read.parquet(f"{folder}/shards")  # one row per writing task
    blocks = spark.read.parquet(f"{folder}/blocks")
    placed = blocks.join(F.broadcast(shards), "shard").select(
        (F.col("before") + F.col("start")).alias("start"),
        "doc_ids", "lengths", "lanes", "words", "states", "offsets", "crc",
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                lengths = np.array(row["lengths"], np.int64)
                lanes = row["lanes"]
                ids = rans.decode(
                    int(lengths.sum()), lanes,
                    np.frombuffer(row["words"], "<u4"),
                    np.frombuffer(row["states"], "<u8").reshape(-1, lanes),
                    np.array(row["offsets"], np.int64),
                    table,
                )
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != row["crc"]:
                    raise ValueError(f"checksum of the block at {row['start']} differs")
                bounds = starts_of(lengths)
                offsets = pa.py_buffer((bounds * 4).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["start"] + bounds[:-1], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.Array.from_buffers(
                            pa.binary(), len(lengths), [None, offsets, pa.py_buffer(raw)]
                        ),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise all texts, write the files below the shared folder and read them back."""
    spark = df.sparkSession
    folder = fresh_path(spark, "token-files")
    pruned = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = materialize(tokenize(pruned, path).drop("text"), "packed-ids")
    write_token_files(ids, folder, "doc_id")
    return read_token_files(spark, folder)
