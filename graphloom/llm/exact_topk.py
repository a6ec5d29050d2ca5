"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are packed into blocks.  At each resolution a vector is cut into segments and keeps each
segment's mean and deviation.  With ``m`` the mean, ``s`` the deviation and ``w`` the length of a
segment, the squared distance of two vectors is at least the sum of ``w ((m1-m2)^2 + (s1-s2)^2)``,
which bounds their inner product by the sum of ``w (m1 m2 + s1 s2)``.  A query's floor is its k-th
best exact score so far, over all blocks its task has seen.  For each pair of blocks the bounds go
from coarse to fine, each a matrix product while many pairs are left; only rows whose bound
reaches the floor get an exact distance.

Every query block meets every candidate block (the query set is part of the question).  The more
query blocks there are, the more candidate blocks one task takes one after another, so that
rows found grow with the input; one window merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize

LEVELS = (2, 8, 32)
CANDIDATES, QUERIES = 2048, 512
LOT = 2  # least candidate blocks in a piece of work
SPARSE = 1 / 16  # below this share of pairs single ones are cheaper than a matrix product
_BLOCK = "dim int, ids binary, rows binary, stats binary"


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: int = 256, keep=()) -> DataFrame:
    """``vec_id, dim, v array<bigint>`` and ``keep``: floor(scale * x) of each component as a double.

    Rows with a null id or vector, or with a null or non-finite component, are left out.
    """
    x = F.col(vector)
    fine = F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    kept = df.filter(F.col(vec_id).isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    return kept.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.size(x).alias("dim"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"),
        *keep,
    )


def segment_stats(rows: np.ndarray, segments: int) -> np.ndarray:
    """Per row the weighted means, then the weighted deviations, of its segments."""
    n, dim = rows.shape
    segments = max(1, min(segments, dim))
    edges = (np.arange(segments + 1) * dim) // segments
    width = np.diff(edges)
    x = rows.astype(np.float64)
    if not dim:
        return np.zeros((n, 2))
    mean = np.add.reduceat(x, edges[:-1], axis=1) / width
    spread = x - np.repeat(mean, width, axis=1)
    deviation = np.sqrt(np.add.reduceat(spread * spread, edges[:-1], axis=1) / width)
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.concatenate([width, width]))


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows of :func:`whole_vectors` packed into blocks of one dimension and ``size`` rows."""

    def pack(batches):
        held: dict[int, tuple[list, list]] = {}

        def close(dim, ids, rows):
            matrix = np.array(rows, np.int64).reshape(len(rows), dim)
            stats = [segment_stats(matrix, s) for s in LEVELS]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([dim], pa.int32()),
                    pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    pa.array([matrix.tobytes()], pa.binary()),
                    pa.array([np.concatenate(stats, axis=1).tobytes()], pa.binary()),
                ],
                names=["dim", "ids", "rows", "stats"],
            )

        for batch in batches:
            for i, dim, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, rows = held.setdefault(dim, ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield close(dim, *held.pop(dim))
        for dim, (ids, rows) in held.items():
            yield close(dim, ids, rows)

    return df.select("vec_id", "dim", "v").mapInArrow(pack, _BLOCK)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of the rows of ``a`` with those of ``b``, in doubles where they are exact there."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2.0**53:
        return a @ b.T
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


def row_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for each row of ``a`` with the one row of ``b`` beside it."""
    if a.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2.0**53:
        return np.einsum("ij,ij->i", a, b)
    return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)


class Queries:
    """A block of queries with what they have found so far."""

    def __init__(self, ids, rows, stats, levels, k):
        self.ids, self.rows, self.stats, self.k = ids, rows, stats, k
        self.edges = np.concatenate([[0], np.cumsum(levels)])
        self.norm = 1 + np.linalg.norm(rows.astype(float), axis=1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id) in order
        self.floor = np.full(len(ids), -np.inf)

    def take(self, ids, rows, stats) -> None:
        """Meet a block of candidates."""
        slack = 1e-9 * self.norm[:, None] * (1 + np.linalg.norm(rows.astype(float), axis=1))[None, :]
        alive = self.ids[:, None] != ids[None, :]
        for number, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            if number and alive.mean() < SPARSE:
                q, c = np.nonzero(alive)
                bound = np.einsum("ij,ij->i", self.stats[q, a:b], stats[c, a:b]) + slack[q, c]
                alive[q, c] = bound >= self.floor[q]
            else:
                bound = self.stats[:, a:b] @ stats[:, a:b].T + slack
                alive &= bound >= self.floor[:, None]
                if not number:
                    self._raise_floors(bound, alive, ids, rows)
                    alive &= bound >= self.floor[:, None]
        if alive.mean() < SPARSE:
            q, c = np.nonzero(alive)
            scores = np.zeros(alive.shape, np.int64)
            scores[q, c] = row_products(self.rows[q], rows[c])
        else:
            scores = products(self.rows, rows)
        alive &= scores >= self.floor[:, None]
        for q in np.flatnonzero(alive.any(axis=1)):
            some = np.flatnonzero(alive[q])
            score = scores[q, some]
            if len(some) > self.k:
                # The k best and all that tie with the last of them.
                last = np.partition(score, len(score) - self.k)[len(score) - self.k]
                some, score = some[score >= last], score[score >= last]
            new = zip((-score).tolist(), ids[some].tolist(), strict=True)
            self.best[q] = sorted([*self.best[q], *new])[: self.k]
            if len(self.best[q]) == self.k:
                self.floor[q] = max(self.floor[q], -self.best[q][-1][0])

    def _raise_floors(self, bound, alive, ids, rows) -> None:
        """The exact scores of the k best coarse bounds are a floor before any row is taken."""
        k = self.k
        if alive.shape[1] < k:
            return
        first = np.argpartition(np.where(alive, -bound, np.inf), k - 1, axis=1)[:, :k]
        q = np.repeat(np.arange(len(self.ids)), k)
        scores = row_products(self.rows[q], rows[first.ravel()]).reshape(-1, k)
        sure = np.take_along_axis(alive, first, axis=1).all(axis=1)
        self.floor = np.where(sure, np.maximum(self.floor, scores.min(axis=1)), self.floor)

    def found(self):
        for q, best in enumerate(self.best):
            for score, vec_id in best:
                yield q, int(self.ids[q]), vec_id, -score


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """Rows of :func:`whole_vectors` dealt into ``blocks``, each packed into one row."""
    # A number of its own deals also rows that repeat one id.
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")

    def pack(key, table):
        dim = key[0].as_py()
        ids = table["vec_id"].to_numpy().astype(np.int64)
        matrix = np.array(table["v"].to_pylist(), np.int64).reshape(len(ids), dim)
        stats = np.concatenate([segment_stats(matrix, s) for s in LEVELS], axis=1)
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()), "blk": pa.array([key[1].as_py()], pa.int32()),
                "ids": pa.array([ids.tobytes()], pa.binary()), "rows": pa.array([matrix.tobytes()], pa.binary()),
                "stats": pa.array([stats.tobytes()], pa.binary()),
            }
        )

    schema = "dim int, blk int, ids binary, rows binary, stats binary"
    return queries.withColumn("blk", place).groupBy("dim", "blk").applyInArrow(pack, schema)


def exact_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows of ``vectors`` by the integer
    inner product, ties to the smaller id; a row with the query's own id is no candidate.

    Queries and rows that :func:`whole_vectors` leaves out take no part, and vectors of different
    lengths are not compared.  A query with fewer candidates gets all; empty tables give no rows.
    Repeated rows count each for itself.
    """
    rows = materialize(_blocks(whole_vectors(vectors, vec_id, vector), CANDIDATES), "vectors")
    wanted = whole_vectors(queries, vec_id, vector)
    blocks = max(1, -(-wanted.count() // QUERIES))
    asked = materialize(query_blocks(wanted, blocks), "queries")
    lots = max(1, rows.count() // max(LOT, blocks))
    met = asked.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), F.lit(0).alias("role")
    ).unionByName(
        rows.withColumn("lot", F.pmod(F.xxhash64("ids"), F.lit(lots)).cast("int")).select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"), F.lit(1).alias("role")
        )
    )
    met = met.withColumn("piece", F.col("blk") * lots + F.col("lot")).repartitionById(blocks * lots, "piece")

    def search(batches):
        here = work = None

        def close():
            made = list(zip(*work.found(), strict=True)) or [[]] * 4
            n = len(made[0])
            columns = [pa.array([v] * n, pa.int32()) for v in here[:2]]
            columns += [pa.array(made[0], pa.int32()), *(pa.array(v, pa.int64()) for v in made[1:])]
            return pa.RecordBatch.from_arrays(columns, names=["dim", "blk", "at", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                key = (row["dim"], row["blk"], row["lot"])
                if key != here:
                    if work:
                        yield close()
                    here, work = key, None
                ids = np.frombuffer(row["ids"], np.int64)
                matrix = np.frombuffer(row["rows"], np.int64).reshape(len(ids), row["dim"])
                stats = np.frombuffer(row["stats"]).reshape(len(ids), -1)
                if row["role"] == 0:
                    work = Queries(ids, matrix, stats, [2 * max(1, min(s, row["dim"])) for s in LEVELS], k)
                elif work:
                    work.take(ids, matrix, stats)
        if work:
            yield close()

    found = met.sortWithinPartitions("dim", "blk", "lot", "role", "ids").mapInArrow(
        search, "dim int, blk int, at int, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("dim", "blk", "at").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
