"""Log-probabilities of whole texts: a word unigram, and a causal self-attention model.

Word counts cover every training text.  They give the unigram score and the start of the attention
model's output table; a word's score is the product of the attention model's probabilities of its
subword ids, and nothing else.

The ``FREQUENT`` most frequent words travel to the tasks as a table; all others meet their counts
in a join, so no vocabulary has to fit anywhere.  The attention model trains on every window of
every training text: blocks of texts are dealt to rounds, and in a round tasks train copies on
batches of the windows that stream by, ``STEPS`` batches at least; their average starts the next round.

Texts are cut into words and encoded once: blocks of ids serve the training and the scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.attention_lm import HALF, SOME, Model, Trainer, Work, windows
from graphloom.llm.batches import PieceCache, as_bytes, chunks, numbered, numbering, slices, starts_of
from graphloom.llm.bpe import Bpe, kept, read_vocabulary
from graphloom.session import materialize

MERGES = 4000  # subword merges of the vocabulary that the model uses
FREQUENT = 150_000  # words of some 100 bytes in a task
ROUNDS, STEPS, BATCH, RATE = 4, 100, 4096, 0.1
HELD = STEPS * BATCH  # windows that a task holds, and trains on in a round if there are so many
BLOCK = 1 << 18  # bytes of texts whose ids travel as one row
ADDERS = 8
KEPT = 250_000
END = b" "  # no word between white space can be this
#: What a block has of each row that asks for a score.
ASKED = {"row": "long", "doc_id": "long", "n_tokens": "long", "base": "double", "known": "double"}


def word_counts(docs: DataFrame) -> DataFrame:
    """``word binary, c long``: words and ends of ``docs(text)``, counted per task first."""

    def count(batches):
        table, total = numbering(), np.zeros(0, np.int64)

        def flush():
            seen = pa.array(list(table), pa.binary())
            return pa.RecordBatch.from_arrays([seen, pa.array(total)], names=["word", "c"])

        for batch in batches:
            for part in slices(batch, 0):
                found, _, pieces = chunks(part.column(0), lower=True)
                words = numbered(table, [*pieces, END])
                n = np.zeros(len(table), np.int64)
                n[: len(total)] = total
                n[words] += np.append(np.bincount(found, minlength=len(pieces)), part.num_rows)
                total = n
                if len(table) > KEPT:
                    yield flush()
                    table, total = numbering(), np.zeros(0, np.int64)
        yield flush()

    counted = docs.select("text").mapInArrow(count, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the vectors in ``rows(vector binary)``, in ``ADDERS`` tasks and then here."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += np.frombuffer(value)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["vector"])

    total = np.zeros(size)
    for row in rows.repartition(ADDERS).mapInArrow(add, "vector binary").toLocalIterator():
        total += np.frombuffer(row["vector"])
    return total


def _bpe(path: str, data) -> Bpe:
    return kept(("lm-bpe", path), lambda: Bpe(data.value, MERGES))


class Words(PieceCache):
    """Encodes words and tells their counts in the training texts; -1: not among the frequent ones."""

    def __init__(self, encode, frequent: dict, limit: int):
        self.frequent = frequent
        super().__init__(encode, limit)

    def clear(self) -> None:
        super().clear()
        self.names, self.known = [], np.zeros(1 << 14, np.int64)

    def _add(self, chunks: list[bytes], at: int) -> None:
        super()._add(chunks, at)
        self.names += chunks
        if len(self.names) > len(self.known):
            self.known = np.resize(self.known, len(self.begins))
        self.known[at : len(self.names)] = [self.frequent.get(w, -1) for w in chunks]


def encoded(texts: DataFrame, counts: DataFrame, path: str) -> DataFrame:
    """Blocks of the rows of ``texts(doc_id, text, learned, asked)``, learned ones and others apart.

    ``n`` windows; ``ids`` and ids per text (``counts``); and of each asked row a number of its own, its id,
    its tokens, how many are known and the sum of log10(c + 1), without the words in ``rare``.
    """
    context = texts.sparkSession.sparkContext
    top = counts.orderBy(F.desc("c"), "word").limit(FREQUENT + 1).collect()  # a bounded number
    all_frequent = len(top) <= FREQUENT
    frequent = context.broadcast({bytes(r["word"]): int(r["c"]) for r in top[:FREQUENT]})
    data = context.broadcast(read_vocabulary(path))

    def block(cache, part, numbers, words, first):
        flat, per_text = cache.of(numbers, words)
        asked = np.asarray(part.column(3).to_pylist(), bool)
        # The tokens of a text are its words and one end.
        owner = np.repeat(np.arange(len(words)), words + 1)
        is_word = np.ones(len(owner), bool)
        is_word[np.cumsum(words + 1) - 1] = False
        number = np.full(len(owner), -1)
        number[is_word] = numbers
        c = np.full(len(owner), cache.frequent.get(END, -1))
        c[is_word] = cache.known[numbers]
        c = np.maximum(c, 0) if all_frequent else c
        sure = c >= 0
        # Whole numbers come back where nothing is counted.
        base = np.bincount(owner[sure], np.log10(c[sure] + 1.0), len(words)).astype(float)
        seen = np.bincount(owner[sure], c[sure] > 0, len(words)).astype(float)
        rest = np.flatnonzero(~sure & asked[owner])
        bounds = np.searchsorted(owner[rest], np.append(np.flatnonzero(asked), len(words)))
        names = [cache.names[i] if i >= 0 else END for i in number[rest].tolist()]
        rare = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(names, pa.binary()))
        row = first + np.arange(asked.sum())
        doc_id = part.column(0).filter(pa.array(asked))
        found = [pa.array(row), doc_id, *(pa.array(x[asked]) for x in (words + 1, base, seen)), rare]
        whole = pa.array([0, len(row)], pa.int32())
        arrays = [
            pa.array([part.column(2)[0].as_py()], pa.bool_()),
            pa.array([int((-(-(per_text + 1) // HALF)).sum())], pa.int64()),
            pa.array([flat.astype(np.uint16).tobytes()], pa.binary()),
            pa.array([per_text.astype(np.int64).tobytes()], pa.binary()),
            *(pa.ListArray.from_arrays(whole, values) for values in found),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["learned", "n", "ids", "counts", *ASKED, "rare"])

    def run(batches):
        cache, first = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            # Of this task alone: later stages have no use for it.
            cache = cache or Words(_bpe(path, data).words, frequent.value, KEPT)
            for learned in (True, False):
                some = batch.filter(pc.equal(batch.column(2), learned))
                for part in slices(some, 1):
                    numbers, words = cache.cut(part.column(1), lower=True)
                    at = row = 0
                    for x in slices(part, 1, BLOCK):
                        mine = words[row : row + x.num_rows]
                        yield block(cache, x, numbers[at : at + mine.sum()], mine, first)
                        row, at, first = row + x.num_rows, at + mine.sum(), first + x.num_rows

    kinds = ", ".join(f"{name} array<{kind}>" for name, kind in ASKED.items())
    rows = texts.select("doc_id", "text", "learned", "asked")
    schema = f"learned boolean, n long, ids binary, counts binary, {kinds}, rare array<array<binary>>"
    return materialize(rows.mapInArrow(run, schema), "ids")


def train(blocks: DataFrame, counts: DataFrame, path: str) -> Model:
    """The attention model of the learned ``blocks`` of :func:`encoded` and the word counts."""
    context = blocks.sparkSession.sparkContext
    raw = read_vocabulary(path)
    data = context.broadcast(raw)
    end = Bpe(raw, MERGES).product.max(initial=511) + 1
    model = Model(int(end) + 1)

    def ids_of_words(batches):
        bpe = _bpe(path, data)
        total = np.zeros(end + 1)
        for batch in batches:
            words, n = as_bytes(batch.column(0)), np.asarray(batch.column(1), float)
            ends = np.array([w == END for w in words], bool)
            total[end] += n[ends].sum()
            ids, per_word = bpe.words([w for w in words if w != END])
            total[: end + 1] += np.bincount(ids, np.repeat(n[~ends], per_word), end + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["vector"])

    uses = _summed(counts.select("word", "c").mapInArrow(ids_of_words, "vector binary"), end + 1) + 0.5
    model.parts["out"] += np.log(uses / uses.sum()).astype(np.float32)

    rows = blocks.filter("learned").select("ids", "counts", "n")
    many = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, many // (ROUNDS * HELD))
    rows = rows.drop("n").withColumn("turn", F.pmod(F.xxhash64("ids"), F.lit(ROUNDS)))
    rows = materialize(rows.repartition(tasks), "ids") if many else rows
    for turn in range(ROUNDS):
        start = context.broadcast(model.vector())
        rate = RATE / (1 + turn)

        share = rows.filter(F.col("turn") == turn).drop("turn")

        def learn(batches, start=start, rate=rate, turn=turn):
            mine = Model(end + 1)
            mine.load(start.value)
            trainer = Trainer(mine, rate)
            rng = np.random.default_rng(turn)
            seen = 0

            def teach(flat, again=False):
                order = rng.permutation(len(flat))
                for i in range(0, len(flat), BATCH):
                    if again and trainer.steps >= STEPS:
                        return
                    some = flat[order[i : i + BATCH]].astype(np.int32)
                    trainer.step(some[:, : 2 * HALF], some[:, 2 * HALF :])

            for held in _streamed(batches, end):
                seen += len(held)
                teach(held)
            while seen and trainer.steps < STEPS:  # then ``held`` is all there is
                teach(held, again=True)
            value = np.append(mine.vector() * seen, seen)
            yield pa.RecordBatch.from_arrays([pa.array([value.tobytes()])], names=["vector"])

        total = _summed(share.mapInArrow(learn, "vector binary"), len(start.value) + 1)
        if total[-1] > 0:
            model.load(total[:-1] / total[-1])
    return model


def _streamed(batches, end: int, turn: int = 0, shares: int = 1):
    """The windows of blocks of ids whose number has the remainder ``turn`` by ``shares``, as rows of
    inputs and targets: ``HELD`` at a time or a little more, the last ones as they are."""
    held, size, number = [], 0, 0
    for batch in batches:
        for ids, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            flat = np.frombuffer(ids, np.uint16).astype(np.int32)
            inputs, targets, _ = windows(flat, np.frombuffer(counts, np.int64), end)
            mine = (number + np.arange(len(inputs))) % shares == turn
            number += len(inputs)
            held.append(np.concatenate([inputs[mine], targets[mine]], axis=1).astype(np.uint16))
            size += len(held[-1])
            if size >= HELD:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


def score_texts(
    docs: DataFrame, train_docs: DataFrame | Column, path: str, doc_id: str = "doc_id", text: str = "text"
):
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    ``train_docs`` is a table of its own or a condition on ``docs``, whose rows are then encoded once
    for both.  Tokens are lower-cased (A-Z) words between ASCII white space and one end per text; null counts
    as empty.  ``base_score`` is the sum of log10((c + 1) / (N + V + 1)), ``score`` the log10
    probability by the attention model alone.  Without training texts all counts are 0 and the model is its
    random start.  Repeated rows are scored each for itself; an empty table gives no rows.
    """
    ids, learned = F.col(doc_id).cast("long").alias("doc_id"), F.lit(False)
    if isinstance(train_docs, Column):
        learned = F.coalesce(train_docs, F.lit(False))
    rows = docs.select(ids, F.col(text).alias("text"), learned.alias("learned"), F.lit(True).alias("asked"))
    if not isinstance(train_docs, Column):
        more = [F.lit(None).cast("long"), F.col(text), F.lit(True), F.lit(False)]
        rows = rows.union(train_docs.select(*more))
    counts = materialize(word_counts(rows.filter("learned")), "word-counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(size["n"]), int(size["v"])
    blocks = encoded(rows, counts, path)
    shared = docs.sparkSession.sparkContext.broadcast(train(blocks, counts, path))

    def run(batches):
        model = shared.value
        tables = model.tables()
        work = Work(SOME, tables)
        for batch in batches:
            for i in range(batch.num_rows):
                flat, per_text = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((0, np.uint16), (1, np.int64)))
                log_p = _token_log10(model, tables, work, flat, per_text)
                sums = np.add.reduceat(log_p, starts_of(per_text + 1)[:-1])
                found = [batch.column(k)[i].values for k in range(2, 2 + len(ASKED))]
                yield pa.RecordBatch.from_arrays([*found, pa.array(sums)], names=[*ASKED, "model"])

    schema = ", ".join(f"{name} {kind}" for name, kind in ASKED.items()) + ", model double"
    asked = blocks.filter(F.size("row") > 0)
    rows = asked.select("ids", "counts", *ASKED).mapInArrow(run, schema)
    each = asked.select(F.explode(F.arrays_zip("row", "rare")).alias("of"))
    rare = each.select(F.col("of.row").alias("row"), F.explode("of.rare").alias("word"))
    met = rare.join(counts.hint("shuffle_hash"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = met.groupBy("row").agg(
        F.sum(F.log10(F.col("c") + 1.0)).alias("base2"),
        F.sum((F.col("c") > 0).cast("long")).alias("known2"),
    )
    out = rows.join(more, "row", "left")
    zero = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        "doc_id", "n_tokens",
        zero("known", "known2").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (zero("base", "base2") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        F.col("model").alias("score"),
    )


def _token_log10(model: Model, tables: dict, work: Work, flat, per_text) -> np.ndarray:
    """log10 probabilities of all ids and ends, text by text."""
    inputs, targets, _ = windows(flat.astype(np.int32), per_text, model.size - 1)
    out = np.zeros(targets.shape)
    for i in range(0, len(inputs), SOME):
        p = model.forward(tables, inputs[i : i + SOME], targets[i : i + SOME], work)["p"]
        out[i : i + SOME] = np.log10(np.maximum(p.astype(float), 1e-30))
    return out[targets != model.size]
