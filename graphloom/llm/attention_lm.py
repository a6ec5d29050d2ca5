"""A small causal self-attention language model, trained and run in numpy.

The model reads subword ids: words between white space, lower-cased, cut by the first merges of
a public vocabulary.  A position attends to itself and the positions before it in its window
(products of learned queries and keys, plus a learned weight for the distance); each attended
token contributes its distribution over ``STATES`` hidden states, and the mixed states give the
next id by their own distributions.  All parts are normalised, so a text's probability is the
product over its ids and the end.

Windows have two chunks of ``HALF`` positions and overlap by one; the second chunk is scored, so
each id is scored once, with at least ``HALF`` positions before it if there are so many.
"""

from __future__ import annotations

import numpy as np

from graphloom.llm.batches import starts_of

HALF, KEY, STATES = 8, 8, 32
WIDTH = STATES + 2 * KEY
SOME = 256  # windows that are worked on at a time, so that a processor's cache holds their arrays
_D = HALF + np.arange(HALF)[:, None] - np.arange(2 * HALF)[None, :]  # distance back to each key
_FUTURE = _D < 0
_AT = np.where(_FUTURE, 0, _D)


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def windows(flat: np.ndarray, counts: np.ndarray, end: int):
    """(inputs n x 2 HALF, targets n x HALF, document of each window).

    A document's inputs are the start mark and its ids, its targets the ids and the end; the start
    mark is the end's id.  Places without a token hold ``end + 1``.
    """
    none = end + 1
    m = counts + 1
    chunks = -(-m // HALF) + 1
    base = starts_of(chunks)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(flat)) - starts_of(counts)[:-1][doc]
    at = base[:-1] * HALF
    inputs = np.full(base[-1] * HALF, none, np.int32)
    targets = np.full(base[-1] * HALF, none, np.int32)
    inputs[at + HALF] = end
    inputs[at[doc] + HALF + 1 + inside] = flat
    targets[at[doc] + HALF + inside] = flat
    targets[at + HALF + counts] = end
    second = np.ones(base[-1], bool)
    second[base[:-1]] = False
    second = np.flatnonzero(second)
    inputs, targets = inputs.reshape(-1, HALF), targets.reshape(-1, HALF)
    both = np.concatenate([inputs[second - 1], inputs[second]], axis=1)
    return both, targets[second], np.repeat(np.arange(len(counts)), chunks - 1)


class Model:
    """Parameters by name; ``size`` ids, the last of which is start and end."""

    def __init__(self, size: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = size
        self.parts = {
            "query": rng.normal(0, 0.3, (size, KEY)),
            "key": rng.normal(0, 0.3, (size, KEY)),
            "distance": -0.3 * np.arange(2 * HALF, dtype=float),
            "state": rng.normal(0, 0.5, (size, STATES)),
            "out": rng.normal(0, 0.5, (STATES, size)),
        }
        self.parts = {k: v.astype(np.float32) for k, v in self.parts.items()}

    def vector(self) -> np.ndarray:
        return np.concatenate([self.parts[k].ravel() for k in sorted(self.parts)]).astype(float)

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for k in sorted(self.parts):
            n = self.parts[k].size
            self.parts[k] = vector[at : at + n].reshape(self.parts[k].shape).astype(np.float32)
            at += n

    def tables(self) -> dict:
        """Lookup tables with a last row for places without a token.  A row of ``inputs`` has the
        id's states, its key and its query."""
        parts = self.parts
        query = parts["query"] / np.float32(np.sqrt(KEY))
        inputs = np.concatenate([softmax(parts["state"]), parts["key"], query], axis=1)
        out = np.ones((self.size + 1, STATES), np.float32)
        out[:-1] = softmax(parts["out"]).T
        return {
            "inputs": np.concatenate([inputs, np.zeros((1, WIDTH), np.float32)]),
            "out": out,
            "distance": np.where(_FUTURE, np.float32(-1e9), parts["distance"][_AT]),
        }

    def forward(self, tables: dict, inputs: np.ndarray, targets: np.ndarray, work: Work | None = None) -> dict:
        """What the windows come to; arrays of ``work`` hold it until it is used again."""
        n = len(inputs)
        work = work or Work(n, tables)
        found, both, weight = work.found[:n], work.both[:n], work.weight[:n]
        tables["inputs"].take(inputs.astype(np.intp), axis=0, out=found, mode="clip")
        given = tables["out"].take(targets.astype(np.intp), axis=0, out=work.given[:n], mode="clip")
        # Queries against keys and targets against states in one product: a product costs more than its sums.
        both[:, :HALF, STATES:] = found[:, HALF:, -KEY:]
        both[:, HALF:, :STATES] = given
        made = np.matmul(both, found[..., :-KEY].transpose(0, 2, 1), out=work.made[:n])
        np.add(made[:, :HALF], tables["distance"], out=weight)
        weight += np.where(inputs == self.size, np.float32(-1e9), np.float32(0))[:, None, :]
        # Places without a token see only such places; their outcome is not used.
        weight -= work.of_each_row(np.maximum, weight)
        np.exp(weight, out=weight)
        weight /= work.of_each_row(np.add, weight)
        p = np.einsum("nij,nij->ni", weight, made[:, HALF:])
        return {"found": found, "both": both, "weight": weight, "of_state": made[:, HALF:], "p": p}

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> dict:
        """Of the mean negative ln probability of the targets."""
        tables = self.tables()
        share = np.float32(1 / max(1, (targets != self.size).sum()))
        work = Work(min(SOME, len(inputs)), tables)
        by_input, by_target = Sums(self.size + 1, WIDTH), Sums(self.size + 1, STATES)
        per_cell = np.zeros(_AT.shape)
        for i in range(0, len(inputs), SOME):
            some, aims = inputs[i : i + SOME], targets[i : i + SOME]
            f = self.forward(tables, some, aims, work)
            n, weight = len(some), f["weight"]
            dp = np.where(aims != self.size, -share / np.maximum(f["p"], np.float32(1e-20)), np.float32(0))
            down, rows, back = work.down[:n], work.rows[:n], work.back[:n]
            np.multiply(weight, dp[..., None], out=down[:, HALF:])
            np.subtract(f["of_state"], f["p"][..., None], out=down[:, :HALF])
            down[:, :HALF] *= down[:, HALF:]
            np.matmul(down.transpose(0, 2, 1), f["both"], out=rows[..., :-KEY])
            np.matmul(down, f["found"][..., :-KEY], out=back)
            rows[:, HALF:, -KEY:] = back[:, :HALF, STATES:]
            by_input.add(some, rows)
            by_target.add(aims, back[:, HALF:, :STATES])
            dscore = down[:, :HALF]
            per_cell += dscore.sum(axis=0)
        sums, state = by_input.rows[:-1], tables["inputs"][:-1, :STATES]
        dstate = sums[:, :STATES]
        out, dout = tables["out"][:-1].T, by_target.rows[:-1].T
        return {
            "query": sums[:, -KEY:] * np.float32(1 / np.sqrt(KEY)),
            "key": sums[:, STATES:-KEY],
            "distance": np.bincount(_AT.ravel(), np.where(_FUTURE, 0, per_cell).ravel(), 2 * HALF),
            "state": state * (dstate - (dstate * state).sum(axis=1, keepdims=True)),
            "out": out * (dout - (dout * out).sum(axis=1, keepdims=True)),
        }


class Work:
    """Arrays for ``n`` windows that parts of a batch use one after another: new ones for each part
    would take the system longer than the arithmetic."""

    def __init__(self, n: int, tables: dict):
        kind = tables["inputs"].dtype
        self.found, self.rows = np.empty((n, 2 * HALF, WIDTH), kind), np.zeros((n, 2 * HALF, WIDTH), kind)
        self.given = np.empty((n, HALF, STATES), np.float32)
        self.weight = np.empty((n, HALF, 2 * HALF), kind)
        # Upper half for queries and keys, lower one for targets and states; the rest of ``both`` stays 0.
        self.both, self.back = np.zeros((n, 2 * HALF, WIDTH - KEY), kind), np.empty((n, 2 * HALF, WIDTH - KEY), kind)
        self.made, self.down = np.empty((n, 2 * HALF, 2 * HALF), kind), np.empty((n, 2 * HALF, 2 * HALF), kind)
        self.halves = [np.empty(self.weight.size >> i, kind) for i in range(1, (2 * HALF).bit_length())]

    def of_each_row(self, op, score: np.ndarray) -> np.ndarray:
        """``op`` over the keys of each query, two neighbours at a time."""
        flat = score.reshape(-1)
        for half in self.halves:
            flat = op(flat[0::2], flat[1::2], out=half[: len(flat) // 2])
        return flat.reshape(-1, HALF, 1)


class Sums:
    """Sums of rows by id, in single precision; two numbers are added at a time, as a complex one."""

    def __init__(self, size: int, width: int):
        self.rows = np.zeros((size, width), np.float32)
        self.places = np.arange(size * width // 2).reshape(size, -1)

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        places = self.places.take(ids.ravel(), axis=0).reshape(-1)
        pairs = values.astype(np.float32, copy=False).reshape(-1).view(np.complex64)
        np.add.at(self.rows.reshape(-1).view(np.complex64), places, pairs)


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, model: Model, rate: float = 0.03):
        self.model, self.rate, self.steps = model, rate, 0
        self.first = {k: np.zeros(v.shape, np.float32) for k, v in model.parts.items()}
        self.second = {k: np.zeros(v.shape, np.float32) for k, v in model.parts.items()}

    def step(self, inputs: np.ndarray, targets: np.ndarray) -> None:
        self.steps += 1
        rate = np.float32(self.rate / (1 - 0.9**self.steps))
        for k, g in self.model.gradients(inputs, targets).items():
            first, second = self.first[k], self.second[k]
            first *= np.float32(0.9)
            first += np.float32(0.1) * g
            second *= np.float32(0.99)
            second += np.float32(0.01) * (g * g)
            scale = np.sqrt(second * np.float32(1 / (1 - 0.99**self.steps)))
            scale += np.float32(1e-8)
            self.model.parts[k] -= (rate * first / scale).astype(np.float32)
