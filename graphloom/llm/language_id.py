"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The probability
of a word is the sum, over all ways to cut it into pieces, of the products of the pieces'
probabilities; a forward pass over the word computes it, for all words of a slice and all
languages at once.  A text's score is the sum over its words and the language's share.

Piece counts come from the segmentation of all training texts, added up per task before one
small shuffle; the model has (pieces seen x languages) numbers, bounded by the vocabulary file
and the number of distinct labels.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import append_columns, as_bytes, numbered, numbering, slices, starts_of
from graphloom.llm.bpe import Bpe, byte_letters, kept, read_vocabulary

UNKNOWN = "und"
PRIOR = 0.02  # added to every count, so that each piece has a probability in each language
KEPT = 250_000  # distinct chunks and words that a worker keeps before it starts anew
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_HAS_LETTER = regex.compile(r"\p{L}")
_MUL = np.uint64(0x100000001B3)


def letter_words(text: str) -> list[bytes]:
    return [w.encode() for w in _LETTERS.findall(text.lower())]


class Pieces:
    """All pieces of the vocabulary: per length in bytes the sorted hashes of (bytes, word end), and
    where each stands in ``ids``."""

    def __init__(self, data: bytes):
        self.bpe = Bpe(data)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        by_size: dict[int, list[tuple[int, int]]] = {}
        for i, token in enumerate(self.bpe.tokens):
            end = token.endswith("</w>")
            letters = token[:-4] if end else token
            if letters and all(c in byte_of for c in letters):
                value = self._hash(bytes(byte_of[c] for c in letters), end)
                by_size.setdefault(len(letters), []).append((value, i))
        self.longest = max(by_size, default=1)
        self.tables, ids = {}, []
        for size, found in sorted(by_size.items()):
            found.sort()
            self.tables[size] = (np.array([h for h, _ in found], np.uint64), len(ids))
            ids += [i for _, i in found]
        self.ids = np.array(ids, np.int64)

    @staticmethod
    def _hash(piece: bytes, end: bool) -> int:
        h = 0
        for b in piece:
            h = ((h + b + 1) * int(_MUL)) & (2**64 - 1)
        return (h ^ (0x5BD1E995 * (len(piece) * 2 + end))) & (2**64 - 1)

    def find(self, rolled: np.ndarray, size: int, ends: np.ndarray) -> np.ndarray:
        """Positions in ``ids``, or -1."""
        if size not in self.tables:
            return np.full(len(rolled), -1)
        hashes, first = self.tables[size]
        key = rolled ^ (np.uint64(0x5BD1E995) * (np.uint64(2 * size) + ends.astype(np.uint64)))
        at = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
        return np.where(hashes[at] == key, at + first, -1)


def word_scores(pieces: Pieces, log_p: np.ndarray, words: list[bytes]) -> np.ndarray:
    """ln P(word | language) for each word and language (words x languages).

    ``log_p`` has a row for each of ``pieces.ids`` and a last row for an unknown byte.
    The forward pass goes over positions; words are sorted by length, so that the words that
    still have a position stand in front.  Long words keep their scale by a running maximum.
    """
    n, languages = len(words), log_p.shape[1]
    lengths = np.fromiter(map(len, words), np.int64, n)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    raw = np.frombuffer(b"".join([words[i] for i in order]), np.uint8).astype(np.uint64)
    begins = starts_of(lengths)
    p = np.exp(log_p)
    longest = int(lengths[0]) if n else 0
    # alpha[position % ring] is the scaled probability of the first bytes up to the position.
    ring = min(pieces.longest, longest) + 1
    alpha = np.zeros((ring, n, languages))
    alpha[0] = 1.0
    scale = np.zeros((n, languages))
    out = np.zeros((n, languages))
    for end in range(1, longest + 1):
        live = int(np.searchsorted(-lengths, -end, side="right"))
        alpha = alpha[:, :live]
        now = alpha[end % ring]
        now[:] = 0.0
        at_end = lengths[:live] == end
        rolled = np.zeros(live, np.uint64)
        power = np.ones(1, np.uint64)
        for size in range(1, min(ring - 1, end) + 1):
            # The hash of the last ``size`` bytes, grown to the left.
            power = power * _MUL
            rolled = rolled + (raw[begins[:live] + (end - size)] + np.uint64(1)) * power
            found = pieces.find(rolled, size, at_end)
            before = alpha[(end - size) % ring]
            if size == 1:
                now += before * p[found]
                continue
            hit = np.flatnonzero(found >= 0)
            now[hit] += before[hit] * p[found[hit]]
        if end % 8 == 0:
            top = alpha.max(axis=0)
            alpha /= top
            scale[:live] += np.log(top)
        first = int(np.searchsorted(-lengths, -end, side="left"))
        if first < live:
            out[first:live] = np.log(alpha[end % ring, first:live]) + scale[first:live]
    result = np.empty_like(out)
    result[order] = out
    return result


def piece_counts(train: DataFrame, path: str, text: str, lang: str) -> DataFrame:
    """``lang, piece, n``: pieces in the segmentation of all words, by language."""
    data = train.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def count(batches):
        bpe = kept(("langid-bpe", path), lambda: Bpe(data.value))
        totals: dict[str, np.ndarray] = {}
        table = numbering()  # chunks between white space
        uses: dict[str, np.ndarray] = {}

        def flush():
            words = numbering()
            found = [numbered(words, letter_words(c.decode())) for c in table]
            per_chunk = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate([np.zeros(0, np.int64), *found])
            ids, per_word = bpe.words(list(words))
            owner = np.repeat(np.arange(len(per_word)), per_word)
            for name, n in uses.items():
                chunk_uses = np.zeros(len(table))
                chunk_uses[: len(n)] = n
                word_uses = np.bincount(flat, np.repeat(chunk_uses, per_chunk), len(words))
                got = np.bincount(ids, word_uses[owner], bpe.size)
                totals[name] = totals.get(name, 0) + got.astype(np.int64)
            table.clear()
            uses.clear()

        for batch in batches:
            for part in slices(batch, 0):
                by_lang: dict[str, list] = {}
                for text, name in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    by_lang.setdefault(name, []).append(numbered(table, text.split()))
                for name, found in by_lang.items():
                    n = np.bincount(np.concatenate(found), minlength=len(table))
                    old = uses.get(name, n[:0])
                    n[: len(old)] += old
                    uses[name] = n
                if len(table) > KEPT:
                    flush()
        flush()
        for name, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(seen), pa.string()),
                    pa.array(seen, pa.int64()),
                    pa.array(total[seen], pa.int64()),
                ],
                names=["lang", "piece", "n"],
            )

    rows = train.filter(F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    counted = rows.mapInArrow(count, "lang string, piece long, n long")
    return counted.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class _Scores:
    """Numbers of distinct items with a row of values each, kept up to ``KEPT`` items."""

    def __init__(self, width: int):
        self.width = width
        self.trim(-1)

    def trim(self, limit: int = KEPT) -> None:
        if limit < 0 or len(self.table) > limit:
            self.table = numbering()
            self.values = np.zeros((0, self.width))

    def number(self, items: list[bytes]) -> np.ndarray:
        return numbered(self.table, items)

    def update(self, score) -> None:
        new = list(islice(self.table, len(self.values), None))
        if new:
            self.values = np.concatenate([self.values.reshape(-1, self.width), score(new)])


def predict_language(
    docs: DataFrame, train: DataFrame, path: str, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Append ``lang_pred string`` and ``score double`` (the posterior share of that language).

    Learns from the rows of ``train`` with a language.  A text that is null or has no letter,
    and any text when nothing was learned, gets ``und`` and score 0.  Ties go to the smaller
    name.  Other columns, ``lang`` too, take no part and pass through.
    """
    counts = piece_counts(train, path, text, lang).toPandas()  # pieces x languages: see above
    shares = train.filter(F.col(lang).isNotNull()).groupBy(lang).count().toPandas()
    names = sorted(shares[lang])
    context = docs.sparkSession.sparkContext
    data = context.broadcast(read_vocabulary(path))
    weight = shares.set_index(lang)["count"].reindex(names).to_numpy(float)
    prior = np.log(weight / weight.sum()) if names else np.zeros(0)
    learned = context.broadcast((names, prior, counts))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def make():
        names, prior, counts = learned.value
        pieces = kept(("pieces", path), lambda: Pieces(data.value))
        dense = np.zeros((pieces.bpe.size, len(names)))
        where = {name: i for i, name in enumerate(names)}
        dense[counts["piece"].to_numpy(int), counts["lang"].map(where).to_numpy(int)] = counts["n"]
        table = np.concatenate([dense[pieces.ids], np.zeros((1, len(names)))]) + PRIOR
        log_p = np.log(table / table.sum(axis=0))
        chunks = _Scores(len(names) + 1)
        words = _Scores(len(names))

        def add_words(new: list[bytes]) -> np.ndarray:
            return np.concatenate(
                [word_scores(pieces, log_p, new[i : i + 50_000]) for i in range(0, len(new), 50_000)]
            )

        def add_chunks(new: list[bytes]) -> np.ndarray:
            """Score sums of chunks; the last column tells whether there is a letter."""
            texts = [c.decode() for c in new]
            found = [words.number(letter_words(t)) for t in texts]
            words.update(add_words)
            owner = np.repeat(np.arange(len(new)), np.fromiter(map(len, found), np.int64, len(new)))
            flat = words.values[np.concatenate(found)]
            sums = [np.bincount(owner, flat[:, i], len(new)) for i in range(len(names))]
            letter = np.fromiter((bool(_HAS_LETTER.search(t)) for t in texts), float, len(new))
            return np.stack([*sums, letter], axis=1)

        def work(columns):
            texts = as_bytes(columns[0])
            if not names:
                return [pa.array([UNKNOWN] * len(texts)), pa.array([0.0] * len(texts))]
            for kept_scores in (chunks, words):
                kept_scores.trim()
            found = [chunks.number(t.split()) for t in texts]
            chunks.update(add_chunks)
            preds, scores = [], []
            for uses in found:
                total = chunks.values[uses].sum(axis=0) if len(uses) else np.zeros(len(names) + 1)
                if not total[-1]:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = prior + total[:-1]
                best = int(np.argmax(total))
                preds.append(names[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            return [pa.array(preds, pa.string()), pa.array(scores, pa.float64())]

        return work

    return append_columns(docs, [text], fields, make)
