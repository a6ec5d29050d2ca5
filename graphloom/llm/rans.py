"""A static range asymmetric numeral system over numpy lanes.

Symbol ``i`` of a block goes to lane ``i % lanes``; all lanes share one frequency table and one
stream of 32-bit words.  The coder walks the symbols backwards, so that the decoder reads
forwards.  Every ``STRIDE`` steps the lanes' states and the place in the stream are kept as a
checkpoint: a decoder can start there, and :func:`decode` runs all stretches side by side.
"""

from __future__ import annotations

import numpy as np

SCALE = 20  # the frequencies of a table add up to 2 ** SCALE
# States lie in [2 ** 31, 2 ** 63), so signed numbers hold them, and index arrays without a conversion.
_LOW = np.int64(1 << 31)
_WORD = np.int64(32)
STRIDE = 256


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2 ** SCALE, at least 1 for each symbol that occurs.

    The largest remainders get what rounding leaves; what rounding up takes comes from the
    largest frequencies, so at most 2 ** SCALE symbols may occur.
    """
    total = 1 << SCALE
    counts = counts.astype(np.float64)
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), np.int64)
    if seen.sum() > total:
        raise ValueError(f"more than {total} symbols")
    exact = counts * (total / counts.sum())
    out = np.where(seen, np.maximum(np.floor(exact), 1), 0).astype(np.int64)
    short = total - int(out.sum())
    if short > 0:
        order = np.argsort(-(exact - out), kind="stable")[:short]
        out[order[seen[order]]] += 1
        short = total - int(out.sum())
    if short > 0:
        out[int(np.argmax(out))] += short
    while short < 0:  # each pass takes at most half of what a symbol has above 1
        order = np.argsort(-out, kind="stable")
        room = (out[order] - 1 + 1) // 2
        take = np.minimum(room, np.maximum(-short - (np.cumsum(room) - room), 0))
        out[order] -= take
        short = total - int(out.sum())
    return out


class Table:
    """Frequencies with their cumulative sums and the symbol of each slot."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.int64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.int32), frequencies)


def lanes_for(n: int) -> int:
    """Interleaved lanes of a block of n symbols: few for short blocks, as states take room."""
    return int(min(256, max(1, n // 256)))


def encode(symbols: np.ndarray, table: Table) -> dict:
    """The coded block: ``n, lanes, words`` and, by checkpoint, ``states`` and ``offsets``."""
    n = len(symbols)
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    padded = np.zeros(steps * lanes, np.int64)
    padded[:n] = symbols
    freq = table.freq[padded].reshape(steps, lanes)
    base = table.base[padded].reshape(steps, lanes)
    limit, rest = freq << np.int64(31 - SCALE + 32), np.int64(1 << SCALE) - freq
    state = np.full(lanes, _LOW)
    emitted: list[np.ndarray] = []
    sizes = np.zeros(steps + 1, np.int64)
    states = []
    for step, f, most, r, b in zip(range(steps - 1, -1, -1), freq[::-1], limit[::-1], rest[::-1], base[::-1]):
        x = state
        if step == steps - 1:
            used = n - step * lanes
            x, f, most, r, b = (y[:used] for y in (x, f, most, r, b))
        full = x >= most
        emitted.append(x[full])
        sizes[step] = len(emitted[-1])
        np.right_shift(x, _WORD, out=x, where=full)
        # The quotient times 2 ** SCALE, the remainder and the base.
        quotient = x // f
        quotient *= r
        x += quotient
        x += b
        if step % STRIDE == 0:
            states.append(state.copy())
    words = np.concatenate(emitted[::-1]).astype(np.uint32) if emitted else np.zeros(0, np.uint32)
    before = np.concatenate([[0], np.cumsum(sizes[:-1])])
    return {
        "n": n,
        "lanes": lanes,
        "words": words,
        "states": np.array(states[::-1], np.int64).astype(np.uint64).reshape(-1, lanes),
        "offsets": before[0:steps:STRIDE].astype(np.int64),
    }


def decode(n, lanes, words, states, offsets, table: Table) -> np.ndarray:
    """The symbols of a block.  Each checkpoint's stretch reads its own part of the stream."""
    if not n:
        return np.zeros(0, np.uint32)
    steps = -(-n // lanes)
    stretches = len(offsets)
    out = np.zeros((stretches, STRIDE, lanes), np.uint32)
    state = states.astype(np.int64)  # stretches x lanes
    at = np.asarray(offsets, np.int64).copy()
    mask, scale = np.int64((1 << SCALE) - 1), np.int64(SCALE)
    words = np.asarray(words).astype(np.int64)
    rest = steps - (stretches - 1) * STRIDE  # steps of the last stretch
    tail = n - (steps - 1) * lanes  # lanes in use in the last step
    for k in range(min(STRIDE, steps)):
        live = stretches if k < rest else stretches - 1
        x = state[:live]
        idle = x[-1, tail:].copy() if k == rest - 1 and tail < lanes else None
        slot = x & mask
        symbol = table.symbol.take(slot)
        out[:live, k] = symbol
        x >>= scale
        x *= table.freq.take(symbol)
        x += slot
        x -= table.base.take(symbol)
        if idle is not None:
            x[-1, tail:] = idle  # they hold no symbol in this step
        need = x < _LOW
        counts = need.sum(axis=1)
        flat, short = x.reshape(-1), np.flatnonzero(need)
        before = np.cumsum(counts) - counts
        place = np.arange(len(short)) + np.repeat(at[:live] - before, counts)
        flat[short] = (flat[short] << _WORD) | words.take(place)
        at[:live] += counts
    return out.reshape(-1, lanes)[:steps].reshape(-1)[:n]
