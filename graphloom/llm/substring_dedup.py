"""Removal of word windows that an earlier document already holds, by Rabin-Karp hashes.

Documents are dealt into blocks by a hash of the row.  A block's task cuts its texts into words in
numpy, and takes the Rabin-Karp hash of every window of ``window`` words of one document.  Then

1. *Counting.*  Each block sends the distinct hashes of its windows, 32 bits of each, to the bucket
   of the hash: one packed row per block and bucket.  A bucket answers with those that two
   blocks hold.  A passage that a third of all documents share is one value per block.
2. *First documents.*  Only windows that repeat become Spark rows: 96 bits of hash, and the
   smallest and largest document of the block that holds it.  The smallest over all blocks
   is one window function over the hash, and an answer goes back where a larger document is.
   Back in its block, 64 bits tell a window from the million others there.
3. *Intervals.*  A block hashes its windows again, marks those with an answer smaller than
   their document, and merges them into maximal intervals of words to remove.

The texts are shuffled once: all three steps read the same exchange.  What else travels is 4
bytes a window and some 25 bytes for each repeated one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.batches import starts_of
from graphloom.llm.decontaminate import mixed

WINDOW = 50
BLOCK_BYTES = 8 << 20  # text in one block
BUCKET_BYTES = 24 << 20  # text whose windows meet in one bucket: some four million
LONG_WORD = 32  # bytes; longer words are hashed one by one
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd: they have an inverse
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin and end of each word, words per text) of texts ``data[offsets[i]:offsets[i + 1]]``."""
    blank = _SPACE[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = blank
    after = np.ones(len(data) + 1, bool)
    after[:-1] = blank
    before[offsets] = True  # a text's first byte follows no word, and none follows its last
    after[offsets] = True
    begins = np.flatnonzero(~blank & before[:-1])
    ends = np.flatnonzero(~blank & after[1:]) + 1
    return begins, ends, np.diff(np.searchsorted(begins, offsets))


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word, the same in every process."""
    import xxhash

    sizes = ends - begins
    out = sizes.astype(np.uint64)
    order = np.argsort(sizes, kind="stable")
    first = np.searchsorted(sizes[order], np.arange(LONG_WORD + 2))
    for k in range(min(LONG_WORD, int(sizes.max(initial=0)))):
        have = order[first[k + 1] :]  # words longer than k
        out[have] = out[have] * np.uint64(_BASE[0]) + data[begins[have] + k]
    for i in order[first[LONG_WORD + 1] :]:
        out[i] = xxhash.xxh3_64_intdigest(data[begins[i] : ends[i]].tobytes())
    return mixed(out)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(codes: np.ndarray, size: int, base: int) -> np.ndarray:
    """The Rabin-Karp hash, modulo 2**64, of every ``size`` consecutive codes: a difference of
    prefix sums of ``codes[i] * base**i``, brought back by ``base**-i``."""
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _powers(base, n)[:n], out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), n - size)
    return mixed((sums[size:] - sums[:-size]) * back)


class Texts:
    """The words and windows of a block's texts."""

    def __init__(self, column: pa.ChunkedArray, window: int):
        self.values = [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
        sizes = np.fromiter(map(len, self.values), np.int64, len(self.values))
        data = np.frombuffer(b"".join(self.values), np.uint8)
        begins, ends, self.n_words = words_in(data, starts_of(sizes))
        self.codes = word_hashes(data, begins, ends)
        self.first = starts_of(self.n_words)
        text = np.repeat(np.arange(len(self.values)), self.n_words)
        starts = np.arange(max(0, len(self.codes) - window + 1))
        self.starts = starts[starts + window <= self.first[text[starts] + 1]]
        self.text = text[self.starts]  # of each window
        self.window = window

    def hashes(self) -> np.ndarray:
        return window_hashes(self.codes, self.window, _BASE[0])[self.starts]

    def checks(self) -> np.ndarray:
        """32 bits of a second hash."""
        second = window_hashes(self.codes, self.window, _BASE[1])[self.starts]
        return (second >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Document ids, and which of them are there."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy().astype(np.int64), there


def _packed(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(v, dtype) for v in column.to_pylist()] or [np.zeros(0, dtype)])


def repeated_intervals(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``doc_id, n_words, removed, kept`` for each row of ``docs``.

    A word is a run of bytes other than ASCII white space.  ``removed`` holds the maximal intervals
    ``(begin, end)`` of words covered by a window whose words also start in a document with a
    smaller id; ``kept`` joins the other words by one space.  Windows are judged on the input.

    A null or empty text has no words.  Rows without id keep all their words and take none from
    others.  Rows of the same id are one document: repeats among them stay.  Other columns,
    whatever their names, are not read, and an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = (max(least, size // share + 1) for share in (BLOCK_BYTES, BUCKET_BYTES))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    blocked = rows.withColumn("block", place).repartition(blocks, "block").groupBy("block")

    def send(key, table):
        """One packed row per bucket: the distinct hashes of the block's windows."""
        texts = Texts(table["text"], window)
        _, there = _ids(table["doc_id"])
        hashes = np.unique(texts.hashes()[there[texts.text]])
        bucket = _bucket(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(bounds))
        return pa.table(
            {
                "bucket": pa.array(some, pa.int32()),
                "block": pa.array(np.full(len(some), key[0].as_py()), pa.int32()),
                "hashes": pa.array([low[bounds[b] : bounds[b + 1]].tobytes() for b in some], pa.binary()),
            }
        )

    def count(key, table):
        """The hashes that more than one block holds, to each of these blocks."""
        block = table["block"].to_numpy()
        held = [np.unique(np.frombuffer(v, np.uint32)) for v in table["hashes"].to_pylist()]
        values, times = np.unique(np.concatenate(held), return_counts=True)
        again = values[times > 1]
        answers = [h[np.isin(h, again, assume_unique=True)] for h in held]
        return pa.table(
            {
                "block": pa.array(block, pa.int32()),
                "bucket": pa.array(np.full(len(block), key[0].as_py()), pa.int32()),
                "hashes": pa.array([a.tobytes() for a in answers], pa.binary()),
            }
        ).filter(pa.array([len(a) > 0 for a in answers], pa.bool_()))

    def repeats(key, table, answers):
        """The block's windows that repeat, with its smallest and largest document for each."""
        texts = Texts(table["text"], window)
        ids, there = _ids(table["doc_id"])
        used = there[texts.text]
        hashes, checks, ids = texts.hashes()[used], texts.checks()[used], ids[texts.text[used]]
        # Bucket and value in one number: where the number of buckets is below 2**32 nothing is lost.
        named = _bucket(hashes, buckets).astype(np.uint64) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
        asked = [
            np.frombuffer(v, np.uint32).astype(np.uint64) | np.uint64(b << 32)
            for b, v in zip(answers["bucket"].to_pylist(), answers["hashes"].to_pylist(), strict=True)
        ]
        elsewhere = np.isin(named, np.concatenate(asked or [named[:0]]))
        order = np.lexsort((ids, checks, hashes))
        hashes, checks, ids, elsewhere = hashes[order], checks[order], ids[order], elsewhere[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(hashes)) - 1 if len(begins) else begins
        some = elsewhere[begins] | (ids[begins] < ids[ends])
        begins, ends = begins[some], ends[some]
        return pa.table(
            {
                "hash": hashes[begins].view(np.int64),
                "check": checks[begins],
                "block": pa.array(np.full(len(begins), key[0].as_py()), pa.int32()),
                "first": ids[begins],
                "last": ids[ends],
            }
        )

    def remove(key, table, answers):
        """The block's rows with their intervals and the words that stay."""
        texts = Texts(table["text"], window)
        ids, there = _ids(table["doc_id"])
        known, first = answers["hash"].to_numpy(), answers["first"].to_numpy()
        order = np.argsort(known)
        known, first = known[order], first[order]
        marked = np.zeros(0, np.int64)
        if len(known):
            hashes = texts.hashes().view(np.int64)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = there[texts.text] & (known[at] == hashes) & (first[at] < ids[texts.text])
            marked = texts.starts[hit]
        steps = np.zeros(len(texts.codes) + 1, np.int64)
        np.add.at(steps, marked, 1)
        np.add.at(steps, marked + window, -1)
        gone = np.cumsum(steps)[:-1] > 0
        removed, kept = [], []
        for i, value in enumerate(texts.values):
            words, mine = value.split(), gone[texts.first[i] : texts.first[i + 1]]
            edges = np.flatnonzero(np.diff(mine, prepend=False, append=False)).reshape(-1, 2)
            removed.append([{"begin": int(b), "end": int(e)} for b, e in edges])
            if len(edges):
                words = [w for w, out in zip(words, mine.tolist(), strict=True) if not out]
            kept.append(b" ".join(words))
        spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": texts.n_words.astype(np.int64),
                "removed": pa.array(removed, spans),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    packed = "bucket int, block int, hashes binary"
    sent = blocked.applyInArrow(send, packed).repartition(buckets, "bucket").groupBy("bucket")
    counted = sent.applyInArrow(count, "block int, bucket int, hashes binary")
    again = blocked.cogroup(counted.groupBy("block")).applyInArrow(
        repeats, "hash long, check int, block int, first long, last long"
    )
    of_hash = Window.partitionBy("hash", "check")
    answers = again.withColumn("first", F.min("first").over(of_hash)).filter("first < last").drop("last", "check")
    return blocked.cogroup(answers.groupBy("block")).applyInArrow(
        remove, "doc_id long, n_words long, removed array<struct<begin:long,end:long>>, kept string"
    )
