"""Byte-pair encoding and decoding in batched numpy merge rounds.

The words of many texts lie in one flat symbol array.  A round finds each word's pair of lowest
rank by binary search over the sorted pair keys, merges it wherever it stands in the word and
drops words without a pair, until none is left.  The vocabulary is a public tokenizer file
of the ``tokenizers`` JSON form with word ends, read on the driver and broadcast; its size is
that of the file, whatever the data.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.batches import PieceCache, append_columns, as_bytes, gather, starts_of, values_of

SLICE = 1 << 20  # bytes of texts or ids worked on at a time
_NONE = np.int32(2**31 - 1)
_SPACE = r"\t-\r \x85\xa0  -     　"
# How the vocabulary's tokenizer cuts a normalised text into words.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_WORD_END = "</w>"
_MARKS = ".,;:!?"  # words by themselves behind letters
# Letters whose normal form is one small letter, then at most one mark.
_PLAIN = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+[.,;:!?]?\z"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as itself, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def normal_form(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma is no special case)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Bpe:
    """Merge tables as sorted arrays.  ``merges`` keeps only the first merges of the file."""

    def __init__(self, data: bytes, merges: int | None = None):
        spec = json.loads(data)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]][:merges]
        self.specials = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.specials.values()])
        self.tokens = np.full(self.size, "", object)
        for token, i in (*vocab.items(), *self.specials.items()):
            self.tokens[i] = token
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        self.rank_of = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.rank_of]
        # A merge may be done everywhere in a word at once if what it makes only takes part in
        # later merges; otherwise one place at a time.
        first_use = np.full(self.size, _NONE)
        for side in (left, right):
            np.minimum.at(first_use, side, np.arange(len(pairs), dtype=np.int32))
        self.at_once = first_use[self.product] > np.arange(len(pairs))
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + _WORD_END] for c in letters], np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def raw_or_words(self, items: list) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per item) of words, or of raw chunks in tuples."""
        cut = [
            [i] if isinstance(i, bytes) else [w.encode() for w in _WORD.findall(normal_form(i[0].decode()))]
            for i in items
        ]
        ids, per_word = self.words([w for c in cut for w in c])
        bounds = starts_of(np.fromiter(map(len, cut), np.int64, len(cut)))
        return ids, np.diff(starts_of(per_word)[bounds])

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word) of non-empty words."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not len(lengths):
            return np.zeros(0, np.int32), lengths
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths) - 1
        symbol = self.inner[raw]
        symbol[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        rank = np.full(len(symbol), _NONE)
        rank[:-1] = self._ranks(symbol[:-1], symbol[1:])
        rank[ends] = _NONE
        done_symbols, done_words = [], []
        while len(symbol):
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            count = np.diff(begin, append=len(word))
            lowest = np.minimum.reduceat(rank, begin)
            live = lowest != _NONE
            if not live.all():
                keep = np.repeat(live, count)
                done_symbols.append(symbol[~keep])
                done_words.append(word[~keep])
                symbol, word, rank = symbol[keep], word[keep], rank[keep]
                lowest, count = lowest[live], count[live]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, count))
            # In a run of overlapping pairs every second one merges.
            fresh = np.diff(at, prepend=-2) != 1
            run = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            at = at[(at - run) % 2 == 0]
            if not self.at_once[lowest].all():
                first = np.diff(word[at], prepend=-1) != 0
                at = at[first | self.at_once[rank[at]]]
            symbol[at] = self.product[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            # The merged symbol is last in its word where the dropped one was.
            closes = rank[at + 1] == _NONE
            closes &= np.append(word[1:], -1)[at + 1] != word[at]
            symbol, word, rank = symbol[stay], word[stay], rank[stay]
            now = at - np.arange(len(at))
            rank[now[closes]] = _NONE
            inner = now[~closes]
            rank[inner] = self._ranks(symbol[inner], symbol[inner + 1])
            before = now[(now > 0) & (word[now - 1] == word[now])] - 1
            rank[before] = self._ranks(symbol[before], symbol[before + 1])
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(word, minlength=len(words))


def chunk_cache(words, specials: dict[str, int], chunks=60_000, kept_words=60_000) -> PieceCache:
    """A store for raw chunks of texts over a store for their words.

    ``words(list of bytes)`` encodes normalised words.  Special tokens stand in the raw text.  A
    chunk whose normal form is not stable goes to ``words`` as it is, in a tuple.
    """
    special = re.compile("|".join(map(re.escape, specials)) or "(?!)")

    def plain(text: str) -> list:
        form = normal_form(text)
        if not form.isascii() and normal_form(form) != form:
            return [(text.encode(),)]
        return [w.encode() for w in _WORD.findall(form)]

    def cut(chunk: bytes) -> list:
        text = chunk.decode()
        if "<|" not in text:
            return plain(text)
        out, at = [], 0
        for m in special.finditer(text):
            out += [*plain(text[at : m.start()]), specials[m.group()]]
            at = m.end()
        return out + plain(text[at:])

    def encode(items: list) -> tuple[np.ndarray, np.ndarray]:
        """Words, special ids as numbers and raw chunks in tuples, in any order."""
        known = np.fromiter((isinstance(i, int) for i in items), bool, len(items))
        ids, per_word = words([i for i in items if not isinstance(i, int)])
        size = np.ones(len(items), np.int64)
        size[~known] = per_word
        begins = np.zeros(len(items), np.int64)
        begins[~known] = starts_of(per_word)[:-1]
        begins[known] = len(ids) + np.arange(known.sum())
        extra = np.array([i for i in items if isinstance(i, int)], np.int32)
        return gather(np.concatenate([ids, extra]), begins, size), size

    inner = PieceCache(encode, kept_words)

    def encode_chunks(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Latin letters, alone or before one mark, become words without a function for each chunk."""
        column = pa.array(new, pa.binary()).view(pa.string())
        plain = pc.match_substring_regex(column, _PLAIN)
        letters = pc.utf8_lower(column.filter(plain))
        stems = pc.ascii_rtrim(letters, _MARKS)
        marked = pc.not_equal(pc.binary_length(letters), pc.binary_length(stems))
        marks = pc.utf8_slice_codeunits(letters.filter(marked), -1)
        names = pa.concat_arrays([stems, marks]).dictionary_encode()
        plain, marked = (x.to_numpy(zero_copy_only=False) for x in (plain, marked))
        rest = [cut(new[i]) for i in np.flatnonzero(~plain).tolist()]
        numbers, sizes = inner.numbers([values_of(names.dictionary), *rest])
        found = numbers[names.indices.to_numpy(zero_copy_only=False)]
        pieces = np.ones(len(new), np.int64)
        pieces[plain] += marked
        pieces[~plain] = sizes[1:]
        at, whole = starts_of(pieces), np.repeat(plain, pieces)
        words = np.zeros(at[-1], np.int64)
        words[at[:-1][plain]] = found[: len(stems)]
        words[at[:-1][plain][marked] + 1] = found[len(stems) :]
        words[~whole] = numbers[sizes[0] :]
        return inner.of(words, pieces)

    return PieceCache(encode_chunks, chunks)


_KEPT: dict = {}


def kept(key, make):
    """One value per Python worker and key; workers serve many tasks."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver."""
    with open(path, "rb") as file:
        return file.read()


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids``: the token ids of ``text`` as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids (an empty value, never null).  Special tokens that stand
    literally in a text become their ids; none is added.  Rows, also repeated ones, and all
    other columns pass through; a column named ``ids`` is replaced.
    """
    data = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        def cache_of():
            bpe = Bpe(data.value)
            return chunk_cache(bpe.raw_or_words, bpe.specials)

        cache = kept(("bpe", path), cache_of)

        def work(columns):
            flat, counts = cache.texts(columns[0])
            raw = flat.astype("<u4").tobytes()
            offsets = pa.py_buffer((starts_of(counts) * 4).astype(np.int32).tobytes())
            out = pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets, pa.py_buffer(raw)])
            return [out]

        return work

    return append_columns(df, [text], [T.StructField(ids, T.BinaryType())], make, SLICE)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append ``text``: the tokens of ``ids``, joined by one blank as the vocabulary's library
    joins them when the file names no decoder.  Null ids give an empty text; ids that the
    vocabulary lacks give nothing.  A column named ``text`` is replaced."""
    data = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        tokens = kept(("tokens", path), lambda: Bpe(data.value, 0).tokens)

        def one(raw: bytes) -> str:
            numbers = np.frombuffer(raw, "<u4")
            numbers = numbers[numbers < len(tokens)]
            return " ".join([t for t in tokens[numbers].tolist() if t])

        return lambda columns: [pa.array(map(one, as_bytes(columns[0])), pa.string())]

    return append_columns(df, [ids], [T.StructField(text, T.StringType())], make, SLICE)
