"""Hard negatives by bounds along a spanning tree of anchors.

Anchors are dealt into blocks; each block has the minimum spanning tree of its vectors.  With ``x``
a candidate, ``p`` a parent anchor and ``c`` its child, ``|c.x - p.x| <= |c - p| |x|``.  So from
the root, whose scores are exact, down the tree, the parent's score plus or minus edge length
times the candidate's norm bounds the child's.  Only candidates whose bounds meet the child's
window get their exact score; the others pass their bounds on to the children.

Two rounds of this give the result: in the first a window is what may still be among the best of
the anchor's own label, in the second it is what the scores of these positives allow.  Windows
narrow as blocks go by.  Every block of anchors meets every block of candidates (the anchors are
the question); the more anchor blocks there are, the more candidate blocks one task takes one
after another, so rows that come out grow with the input and not with its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.exact_topk import products, row_products, whole_vectors
from graphloom.session import materialize

ANCHORS, CANDIDATES = 512, 2048  # vectors in a block
LOT = 2  # least candidate blocks in a piece of work
_DENSE = 1 / 16  # from this share of pairs on a matrix product is cheaper than single ones
_ROWS = "dim int, ids binary, labels binary, rows binary"


def spanning_tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, parent, edge)`` of the minimum spanning tree: rows as they join it, the row that
    each hangs on (the root on itself), and the distance between the two."""
    x = rows.astype(np.float64)
    n = len(x)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    best, near, out = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    for i in range(n):
        out[at] = False
        order[i] = at
        parent[at], edge[at] = (near[at], best[at]) if i else (at, 0.0)
        far = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = out & (far < best)
        best[closer], near[closer] = far[closer], at
        if i + 1 < n:
            at = int(np.argmin(np.where(out, best, np.inf)))
    return order, parent, edge


def tree_levels(order: np.ndarray, parent: np.ndarray) -> list[np.ndarray]:
    """Rows of the tree by their distance in edges from the root."""
    depth = np.zeros(len(order), np.int64)
    for at in order[1:]:
        depth[at] = depth[parent[at]] + 1
    return [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=-1)) + 1)]


def scores_by_tree(anchors, levels, parent, edge, rows, windows, allowed):
    """Per level of the tree ``(anchor rows, needed, scores)``: a mask of the candidates whose bounds
    meet the anchor's window, and where it holds, the exact score.

    ``windows(at)`` gives the lowest and highest score of interest of these anchors as columns, and
    ``allowed(at)`` a mask of the candidates that may count at all.
    """
    norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    low = np.zeros((len(anchors), len(rows)))
    high = np.zeros((len(anchors), len(rows)))
    for depth, at in enumerate(levels):
        if depth == 0:
            scores = products(anchors[at], rows)
            low[at] = high[at] = scores
            least, most = windows(at)
            yield at, allowed(at) & (scores >= least) & (scores <= most), scores
            continue
        up = parent[at]
        reach = edge[at][:, None] * norm[None, :] * (1 + 1e-9) + 1e-6
        low[at], high[at] = low[up] - reach, high[up] + reach
        least, most = windows(at)
        needed = allowed(at) & (high[at] >= least) & (low[at] <= most)
        scores = np.zeros(needed.shape, np.int64)
        if needed.mean() > _DENSE:
            scores = products(anchors[at], rows)
            low[at] = high[at] = scores
        else:
            a, c = np.nonzero(needed)
            scores[a, c] = row_products(anchors[at[a]], rows[c])
            low[at[a], c] = high[at[a], c] = scores[a, c]
        yield at, needed, scores


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def _candidate_blocks(rows: DataFrame) -> DataFrame:
    """``rows(vec_id, label, dim, v)`` packed, each block of one dimension and in order of ids."""

    def pack(batches):
        held: dict[int, list] = {}

        def close(dim, found):
            found.sort(key=lambda x: x[0])
            ids, labels = (np.array([x[i] for x in found], np.int64) for i in (0, 1))
            matrix = np.array([x[2] for x in found], np.int64).reshape(len(found), dim)
            made = [pa.array([dim], pa.int32()), *_binary(ids, labels, matrix)]
            return pa.RecordBatch.from_arrays(made, names=["dim", "ids", "labels", "rows"])

        for batch in batches:
            for i, label, dim, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = held.setdefault(dim, [])
                found.append((i, label, v))
                if len(found) == CANDIDATES:
                    yield close(dim, held.pop(dim))
        for dim, found in held.items():
            yield close(dim, found)

    return rows.select("vec_id", "label", "dim", "v").mapInArrow(pack, _ROWS)


def _anchor_blocks(anchors: DataFrame, blocks: int) -> DataFrame:
    """The anchors in blocks, each with its spanning tree."""
    # A number of its own deals also rows that repeat one id.
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")

    def pack(key, table):
        dim = key[0].as_py()
        ids, labels = (table[c].to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        matrix = np.array(table["v"].to_pylist(), np.int64).reshape(len(ids), dim)
        order, parent, edge = spanning_tree(matrix)
        values = [pa.array([k.as_py()], pa.int32()) for k in key]
        values += _binary(ids, labels, matrix, order, parent, edge)
        return pa.Table.from_arrays(values, names=["dim", "blk", "ids", "labels", "rows", "ord", "parent", "edge"])

    schema = "dim int, blk int, ids binary, labels binary, rows binary, ord binary, parent binary, edge binary"
    return anchors.withColumn("blk", place).groupBy("dim", "blk").applyInArrow(pack, schema)


class _Anchors:
    """A block of anchors in a task, with the windows that narrow as candidates go by."""

    def __init__(self, row: dict, k: int):
        dim = row["dim"]
        self.ids, self.labels, self.parent, order = (
            np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "parent", "ord")
        )
        self.rows = np.frombuffer(row["rows"], np.int64).reshape(len(self.ids), dim)
        self.edge = np.frombuffer(row["edge"])
        self.levels = tree_levels(order, self.parent)
        self.k = k

    def search(self, row: dict, windows, same: bool):
        """``(anchor row, ids and scores by rank)`` for each anchor with needed candidates."""
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        rows = np.frombuffer(row["rows"], np.int64).reshape(len(ids), self.rows.shape[1])

        def allowed(at):
            alike = self.labels[at][:, None] == labels[None, :]
            return alike & (self.ids[at][:, None] != ids[None, :]) if same else ~alike

        for at, needed, scores in scores_by_tree(
            self.rows, self.levels, self.parent, self.edge, rows, windows, allowed
        ):
            for i in np.flatnonzero(needed.any(axis=1)):
                some = np.flatnonzero(needed[i])
                score = scores[i, some]
                if same and len(some) > 4 * self.k:
                    # The k best and all that tie with the last of them.
                    edge = np.partition(score, len(score) - self.k)[len(score) - self.k]
                    some, score = some[score >= edge], score[score >= edge]
                order = np.lexsort((ids[some], -score))
                yield at[i], ids[some[order]], score[order]


class Positives(_Anchors):
    """The best rows of the same label."""

    def __init__(self, row, k, extra):
        super().__init__(row, k)
        self.best = [[] for _ in self.ids]  # (-score, id) in order
        self.floor = np.full(len(self.ids), np.iinfo(np.int64).min)

    def windows(self, at):
        return self.floor[at][:, None], np.inf

    def take(self, row):
        for i, ids, score in self.search(row, self.windows, True):
            new = zip((-score[: self.k]).tolist(), ids[: self.k].tolist(), strict=True)
            self.best[i] = sorted([*self.best[i], *new])[: self.k]
            if len(self.best[i]) == self.k:
                self.floor[i] = -self.best[i][-1][0]

    def found(self):
        for i, best in enumerate(self.best):
            for rank, (score, vec_id) in enumerate(best):
                yield i, rank, int(self.ids[i]), vec_id, -score, 0, 0


class Negatives(_Anchors):
    """For each positive the best rows of other labels with a score in its window."""

    def __init__(self, row, k, extra):
        super().__init__(row, k)
        self.low, self.high = extra["low"], extra["high"]
        self.positives: list[list] = [[] for _ in self.ids]
        for i, rank, vec_id, score in zip(*extra["positives"], strict=True):
            # A negative score has no window: its lower end would be the higher one.
            if self.low * score <= self.high * score:
                self.positives[i].append((rank, vec_id, score, []))
        self.least = np.full(len(self.ids), np.inf)
        self.most = np.full(len(self.ids), -np.inf)
        for i, mine in enumerate(self.positives):
            if mine:
                self.least[i] = min(self.low * p[2] / 100 for p in mine) - 1
                self.most[i] = max(self.high * p[2] / 100 for p in mine) + 1

    def windows(self, at):
        return self.least[at][:, None], self.most[at][:, None]

    def take(self, row):
        for i, ids, score in self.search(row, self.windows, False):
            for _, _, positive, best in self.positives[i]:
                # Scores descend: from the first that is not above the window to its last.
                start = np.searchsorted(-100 * score, -self.high * positive, side="left")
                stop = np.searchsorted(-100 * score, -self.low * positive, side="right")
                take = slice(start, min(stop, start + self.k))
                best.extend(zip((-score[take]).tolist(), ids[take].tolist(), strict=True))
                best.sort()
                del best[self.k :]
            ends = [
                -p[3][-1][0] if len(p[3]) == self.k else self.low * p[2] / 100 - 1 for p in self.positives[i]
            ]
            self.least[i] = min(ends)

    def found(self):
        for i, mine in enumerate(self.positives):
            for rank, vec_id, positive, best in mine:
                for score, negative in best:
                    yield i, rank, int(self.ids[i]), vec_id, positive, negative, -score


_FOUND = "dim int, blk int, at int, rank int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _met(kind, k, anchors, positives, candidates, blocks, lots, low=0, high=0) -> DataFrame:
    """What ``kind`` finds where each block of anchors meets each lot of candidate blocks."""
    lot = F.pmod(F.xxhash64("ids"), F.lit(lots)).cast("int")
    every_lot = F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk")
    parts = [
        anchors.select("*", every_lot, F.lit(0).alias("role")),
        candidates.withColumn("lot", lot).select("*", every_block, F.lit(2).alias("role")),
    ]
    if positives is not None:
        parts.append(positives.select("*", every_lot, F.lit(1).alias("role")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = rows.withColumn("piece", F.col("blk") * lots + F.col("lot")).repartitionById(blocks * lots, "piece")

    def search(batches):
        here = None

        def close():
            made = list(zip(*work.found(), strict=True)) or [[]] * 7
            n = len(made[0])
            columns = [pa.array([v] * n, pa.int32()) for v in here[:2]]
            columns += [pa.array(v, pa.int32()) for v in made[:2]]
            columns += [pa.array(v, pa.int64()) for v in made[2:]]
            return pa.RecordBatch.from_arrays(columns, names=_NAMES)

        work = None
        anchor = extra = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                key = (row["dim"], row["blk"], row["lot"])
                if key != here:
                    if work:
                        yield close()
                    here, work, anchor = key, None, None
                    extra = {"low": low, "high": high, "positives": [[], [], [], []]}
                if row["role"] == 0:
                    anchor = row
                elif row["role"] == 1:
                    extra["positives"] = [row[c] for c in ("p_at", "p_rank", "p_id", "p_score")]
                elif anchor:
                    work = work or kind(anchor, k, extra)
                    work.take(row)
        if work:
            yield close()

    ordered = rows.sortWithinPartitions("dim", "blk", "lot", "role", "ids")
    return ordered.mapInArrow(search, _FOUND)


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80,
    high: int = 100, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row
    where ``anchors`` holds and each of its best ``positives`` rows of the same label, the best
    ``negatives`` rows of other labels whose score is from ``low`` to ``high`` hundredths of the
    positive's.  The score is the integer inner product with the anchor, ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; vectors
    of other lengths are not compared.  A positive with a negative score has no such rows.  Where
    there are fewer rows, all are given; an empty table gives none.  Repeated rows count each for
    itself, but no row with the anchor's own id is its positive.  Other columns are not read.
    """
    kept = vectors.select(
        F.col(f"`{vec_id}`").alias("i"), F.col(f"`{vector}`").alias("x"),
        F.col(f"`{label}`").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asked"),
    ).filter("label IS NOT NULL")
    rows = whole_vectors(kept, "i", "x", keep=("label", "asked"))
    blocks = max(1, -(-rows.filter("asked").count() // ANCHORS))
    asked = materialize(_anchor_blocks(rows.filter("asked").drop("asked"), blocks), "anchors")
    candidates = materialize(_candidate_blocks(rows), "candidates")
    lots = max(1, candidates.count() // max(LOT, blocks))
    # Each of at most blocks * lots pieces gives at most the best of each anchor.
    first = _met(Positives, positives, asked, None, candidates, blocks, lots)
    of_anchor = Window.partitionBy("dim", "blk", "at").orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("rank", F.row_number().over(of_anchor)).filter(F.col("rank") <= positives)
    # A block's positives are at most its anchors times ``positives``.
    packed = first.groupBy("dim", "blk").agg(
        F.sort_array(F.collect_list(F.struct("at", "rank", "positive_id", "positive_score"))).alias("p")
    )
    packed = packed.select(
        "dim", "blk", F.col("p.at").alias("p_at"), F.col("p.rank").alias("p_rank"),
        F.col("p.positive_id").alias("p_id"), F.col("p.positive_score").alias("p_score"),
    )
    packed = materialize(packed, "positives")
    found = _met(Negatives, negatives, asked, packed, candidates, blocks, lots, low, high)
    best = Window.partitionBy("dim", "blk", "at", "rank").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )
