"""Token ids of whole texts, with a cache of encoded words.

Byte-level BPE first cuts a text by a fixed pattern and merges only within the
cuts. Words recur, so texts are cut at places where that pattern cuts too, and
each distinct piece is given to the tokenizer once per worker.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re

import numpy as np
import pyarrow as pa

from credence.llm.common import flat_bytes

#: Pieces remembered by a worker: about 250 MB. A fuller cache starts anew.
CACHE = 1_200_000
#: One white space character between two others is a cut of the pattern.
SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
COMMA, STOP = "\1", "\2"


def _byte_pairs() -> np.ndarray:
    """For each pair of neighbouring bytes, whether a text that has it needs care.

    Plain texts have letters, digits, punctuation, single spaces and line
    feeds, and a comma or full stop only after a letter or digit and before
    one or white space: the pattern cuts on both its sides.
    """
    letter = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xBF), (0xC3, 0xC9)):
        letter[low : high + 1] = True
    space = np.zeros(256, bool)
    space[[0x20, 0x0A]] = True
    mark = np.zeros(256, bool)
    mark[[0x2C, 0x2E]] = True
    other = np.zeros(256, bool)
    other[0x21:0x7F] = True
    other &= ~letter & ~mark
    odd = ~(letter | space | mark | other)
    out = odd[:, None] | odd[None, :] | (space[:, None] & space[None, :])
    out |= ~letter[:, None] & mark[None, :]
    out |= mark[:, None] & ~(letter | space)[None, :]
    out[0xC3, [0x97, 0xB7]] = True  # the two signs among Latin letters
    return out.ravel()


PAIRS = _byte_pairs()


def plain_rows(column: pa.Array) -> np.ndarray:
    """Whether each text of the column is plain."""
    data, offsets = flat_bytes(column)
    if len(data) < 2:
        return np.zeros(len(column), bool)
    hits = np.flatnonzero(PAIRS[data[:-1].astype(np.uint16) * 256 + data[1:]])
    bad = np.searchsorted(offsets, hits, "right") - 1
    out = np.ones(len(column), bool)
    out[bad[hits + 1 < offsets[bad + 1]]] = False
    size = np.diff(offsets)
    out[size < 2] = False
    full = np.flatnonzero(size)
    mark = np.isin(data[offsets[full]], (0x2C, 0x2E))
    out[full[mark]] = False
    return out


class _Index(dict):
    """Numbers keys in the order of arrival."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


def _text_of(key: str) -> str:
    """What a key stands for: text after a space, unless its first character tells otherwise."""
    head = key[:1]
    if head == "\0":
        return key[1:]
    if head == "\n":
        return key
    if head in (COMMA, STOP) and head:
        return ("," if head == COMMA else ".") + key[1:]
    return f" {key}"


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False).ids`` would."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for single words, already cut and written in the byte alphabet
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit("\n")
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {
            b: spell.pre_tokenize_str(chr(b))[0][0] if b < 128 else spell.pre_tokenize_str(self._sample(b))[0][0][-1]
            for b in (*range(0x20, 0x7F), *range(0x80, 0xC0))
        } | {b: spell.pre_tokenize_str(bytes((b, 0x80)).decode())[0][0][0] for b in range(0xC3, 0xCA)}
        self.limit = cache
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    @staticmethod
    def _sample(last: int) -> str:
        """A character whose UTF-8 form ends in the byte ``last``."""
        return bytes((0xC3, last)).decode()

    def clear(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _learn(self) -> None:
        fresh, self.index.fresh = self.index.fresh, []
        simple = [bool(LETTERS.fullmatch(k)) for k in fresh]
        words = [k for k, s in zip(fresh, simple, strict=True) if s]
        rest = [_text_of(k) for k, s in zip(fresh, simple, strict=True) if not s]
        spelt = [" " + w for w in words]
        spelt = [w.encode().decode("latin-1").translate(self.spelt) for w in spelt]
        sizes, values = [], []
        for at in range(0, len(spelt), 1000):
            found = self.words.encode("\n".join(spelt[at : at + 1000]), add_special_tokens=False)
            values.append(np.array(found.ids, np.uint32))
            owner = np.array(found.word_ids, np.int64)
            sizes.append(np.bincount(owner, minlength=len(spelt[at : at + 1000])))
        others = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, others), np.int64, len(others)))
        values.append(np.fromiter((x for i in others for x in i), np.uint32, int(sizes[-1].sum())))
        size, value = np.concatenate(sizes), np.concatenate(values)
        while self.used + len(value) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(value)] = value
        first = self.used + np.cumsum(size) - size
        self.used += len(value)
        # words come first in size and first, the others after them; put them in the keys' order
        order = np.argsort(np.argsort(~np.array(simple), kind="stable"), kind="stable")
        self.first = np.concatenate((self.first, first[order]))
        self.size = np.concatenate((self.size, size[order]))

    def _keys(self, text: str, plain: bool) -> list[str]:
        if plain:
            keys = text.replace("\n", " \n").replace(",", " " + COMMA).replace(".", " " + STOP).split(" ")
            keys[0] = "\0" + keys[0]
            return keys
        if any(s in text for s in self.special) or not text.isprintable() and not text.isascii():
            return ["\0" + text]
        head, *rest = SAFE.split(text)
        keys = [x[1:] if x[0] == " " else x for x in rest]
        if any(k[:1] in ("\0", COMMA, STOP) for k in keys):
            return ["\0" + text]
        return ["\0" + head, *keys]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column in order, and the number of ids of each row; null counts as empty."""
        if len(self.index) > self.limit:
            self.clear()
        numbers, counts = [], []
        get = self.index.__getitem__
        plain = plain_rows(column).tolist()
        for text, easy in zip(column.to_pylist(), plain, strict=True):
            keys = self._keys(text or "", easy and not any(s in text for s in self.special))
            numbers.append(np.fromiter(map(get, keys), np.int64, len(keys)))
            counts.append(len(keys))
        if self.index.fresh:
            self._learn()
        if not numbers:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        number = np.concatenate(numbers)
        size = self.size[number]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[number] - ends + size, size) + np.arange(ends[-1])]
        last = np.cumsum(counts) - 1
        return ids, np.diff(ends[last], prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def released() -> None:
    """Give this worker's encoders back to the system.

    Spark reuses its Python workers. Each would hold its remembered pieces
    through stages that encode nothing.
    """
    if _encoders:
        _encoders.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
            ctypes.CDLL(None).malloc_trim(0)
