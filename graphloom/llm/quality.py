"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

The statistics of a text become ``features`` random cosines, whose inner products approximate a
Gaussian kernel.  Tasks add up the normal equations of the labelled rows; a second round of tasks
adds the sums, and the driver solves a system whose size is a parameter.  Scores of the labelled
rows are counted in fixed bins, and the pool-adjacent-violators rule makes them probabilities.
All labelled rows count; nothing is sampled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import append_columns, as_bytes
from graphloom.session import materialize

FEATURES, RIDGE, SEED, BINS, FOLDS = 256, 1e-3, 7, 2000, 4
THRESHOLD = 0.7
SLICE = 1 << 19  # bytes of texts worked on at a time: some 30 bytes of arrays for each
ADDERS = 32  # tasks of the second round of sums
_CLASS = np.zeros(256, np.int64)
for _name, _codes in enumerate(
    ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".,;:'\"-?()")
):
    _CLASS[[ord(c) for c in _codes]] = _name
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()"]] = 6
_CLASS[128:] = 7
_ODD_END = re.compile(rb"[^\w.,;:'\")?\x80-\xff]$")
WIDTH = 20


def text_statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``WIDTH`` numbers per text; an empty text has zeros."""
    n = len(texts)
    out = np.zeros((n, WIDTH))
    sizes = np.fromiter(map(len, texts), np.int64, n)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    bytes_of = np.bincount(owner * 256 + raw, minlength=256 * n).reshape(n, 256)
    for c in range(8):
        out[:, c] = bytes_of[:, _CLASS == c].sum(axis=1)
    some = np.maximum(sizes, 1)[:, None]
    out[:, :8] /= some
    share = bytes_of / some
    out[:, 8] = -(share * np.log2(np.maximum(share, 1e-12))).sum(axis=1)
    out[:, 9] = np.log1p(sizes)
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        seen: dict = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        count = len(words)
        lines = text.split(b"\n")
        out[i, 10] = np.log1p(count)
        out[i, 11] = sizes[i] / count
        out[i, 12] = len(seen) / count
        out[i, 13] = max(seen.values()) / count
        out[i, 14] = sum(k for w, k in seen.items() if len(w) == 1) / count
        out[i, 15] = sum(k for w, k in seen.items() if _ODD_END.search(w)) / count
        out[i, 16] = np.log1p(len(lines))
        out[i, 17] = len(set(lines)) / len(lines)
        out[i, 18] = np.log(len(seen)) / np.log(count + 1)
        out[i, 19] = np.log1p(max(map(len, words)))
    return out


def with_statistics(df: DataFrame, text: str, out: str = "statistics") -> DataFrame:
    """Append ``out array<double>``: :func:`text_statistics` of ``text`` (null counts as empty)."""

    def make():
        def work(columns):
            stats = text_statistics(as_bytes(columns[0]))
            offsets = pa.array(np.arange(len(stats) + 1, dtype=np.int32) * WIDTH)
            return [pa.ListArray.from_arrays(offsets, pa.array(stats.ravel()))]

        return work

    return append_columns(df, [text], [T.StructField(out, T.ArrayType(T.DoubleType()))], make, SLICE)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), WIDTH)


def partition_sums(df: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``of(batch)`` over all batches of ``df``: in the tasks, then in ``ADDERS`` tasks,
    then over their rows here."""

    def partial(batches):
        total = np.zeros(shape)
        for batch in batches:
            total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += np.frombuffer(value).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    rows = df.mapInArrow(partial, "sums binary").repartition(ADDERS).mapInArrow(add, "sums binary")
    total = np.zeros(shape)
    for row in rows.toLocalIterator():
        total += np.frombuffer(row["sums"]).reshape(shape)
    return total


class Scorer:
    """Standardised statistics, random cosines, ridge weights, then calibration."""

    def __init__(self, mean, spread, features, seed, width):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.directions = rng.normal(size=(WIDTH, features)) * width
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        z = np.cos(x @ self.directions + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.knots)


def isotonic(counts: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to hits / counts, weighted by counts (all above 0)."""
    blocks: list[list[float]] = []
    for n, h in zip(counts.tolist(), hits.tolist(), strict=True):
        blocks.append([n, h, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, h2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + h2, blocks[-1][2] + k2]
    return np.repeat([h / n for n, h, _ in blocks], [k for _, _, k in blocks])


def fit(
    labelled: DataFrame,
    stats: str = "statistics",
    label: str = "label",
    features: int = FEATURES,
    ridge: float = RIDGE,
    seed: int = SEED,
    width: float = 0.12,
) -> Scorer:
    """A scorer from rows with ``stats`` and a 0/1 ``label``; other rows are left out.
    Without rows every score is 0.5."""
    rows = labelled.select(F.col(stats).alias("x"), F.col(label).cast("double").alias("y"))
    rows = rows.filter(F.col("y").isin(0.0, 1.0) & F.col("x").isNotNull())
    # Equal texts share a fold.
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int"))

    def moments(batch):
        x = _matrix(batch.column(0))
        return np.stack([np.full(WIDTH, len(x), float), x.sum(axis=0), (x * x).sum(axis=0)])

    n, first, second = partition_sums(rows, moments, (3, WIDTH))
    n = max(n[0], 1)
    mean = first / n
    scorer = Scorer(mean, np.sqrt(np.maximum(second / n - mean**2, 1e-9)) + 1e-6, features, seed, width)
    size = features + 1

    def equations(batch):
        z = scorer.cosines(_matrix(batch.column(0)))
        y, fold = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        out = np.zeros((FOLDS, size + 1, size))
        for k in np.unique(fold):
            mine = fold == k
            out[k, :-1] = z[mine].T @ z[mine]
            out[k, -1] = z[mine].T @ y[mine]
        return out

    folds = partition_sums(rows, equations, (FOLDS, size + 1, size))
    sums = folds.sum(axis=0)
    if sums[-2, -1] == 0:
        return scorer

    def solve(part):
        penalty = np.eye(size) * (ridge * max(part[-2, -1], 1) / features)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(part[:-1] + penalty, part[-1])

    scorer.weights = solve(sums)
    others = np.stack([solve(sums - part) for part in folds], axis=1)
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def binned(batch):
        z = scorer.cosines(_matrix(batch.column(0)))
        y, fold = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        raw = np.clip((z @ others)[np.arange(len(z)), fold], -0.5, 1.5)
        at = np.clip(np.searchsorted(edges, raw, side="right") - 1, 0, BINS - 1)
        return np.stack([np.bincount(at, w, BINS) for w in (None, y, raw)])

    counts, hits, raw = partition_sums(rows, binned, (3, BINS))
    used = counts > 0
    level = isotonic(counts[used], hits[used])
    # A slight slope keeps the order inside a level.
    centre = raw[used] / counts[used]
    rising = level + 1e-6 * np.clip(centre, 0, 1)
    scorer.knots = (centre, np.clip(rising, 0, 1))
    return scorer


def score_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """Append ``score double`` (0 to 1, higher: label 1 likelier) and ``predicted int`` to docs.

    ``labels`` has ``doc_id`` and ``label``; rows with other labels than 0 and 1, or without a
    document, teach nothing, repeated ones count each.  The id, and any column but the text, is
    no input of a score.  Null texts count as empty and are scored too.  ``predicted`` is 1 from
    ``THRESHOLD`` on.  Columns with the new names are replaced.
    """
    taught = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("label"))
    # Statistics meet the labels, not texts: 160 bytes a document are shuffled.
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    stats = with_statistics(texts, "text").drop("text").join(taught, "id")
    scorer = fit(materialize(stats, "statistics"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # its size is set by FEATURES

    def make():
        def work(columns):
            score = shared.value.score(text_statistics(as_bytes(columns[0])))
            return [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]

        return work

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return append_columns(docs, [text], fields, make, SLICE)
