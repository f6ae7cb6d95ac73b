"""Token ids of whole texts, with a table of the words a worker has met.

The tokenizer treats white space as a border no token crosses, so the ids of a text are those of its
space-separated words in turn. Words repeat; each worker encodes a word once and then looks it up.
Words with ``<|`` are encoded on their own, as they may hold a special token, and so are those with the sign that stands
between words that are encoded together. All texts of a batch are cut at once, as bytes, and a word that is repeated in
them is looked up once. Words of letters alone need no sign between them where the tokenizer marks the last token of a
word: each has one such token at least, so if there are as many as words, each has one.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
# Words a worker remembers (some 200 bytes each), and the longest of them. When half of that is full, it starts again
# and keeps what is asked for once more.
MAX_WORDS = 1_200_000
LONGEST_WORD = 64
# Words per call, and the sign between them: one token of its own between blanks, in no word that is not encoded alone.
_TOGETHER = 128
_BORDER = "\x01"

# A single mark between a letter or digit and a blank is a token of its own, and so may stand apart: the word before it
# is then the same as without it.
_IS_MARK = np.array([chr(b) in ".,;:!?" for b in range(256)])
_BEFORE_MARK = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_BLANK = ord(" ")

_encoders: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        border = self._tokenizer.encode(_BORDER, add_special_tokens=False).ids
        self._border = border[0] if len(border) == 1 else None
        # For each id whether it ends a word; none if the tokenizer does not tell.
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool) if suffix else None
        if suffix:
            self._ends[[i for token, i in self._tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._max_words = max_words
        self.size = self._tokenizer.get_vocab_size()
        self._known: dict[str, bytes] = {"": b""}
        self._before: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def _learn(self, words: Iterable[str]) -> None:
        letters, plain, alone = [], [], []
        for word in words:
            if self._ends is not None and word.isalpha():
                letters.append(word)
            else:
                (alone if self._border is None or "<|" in word or _BORDER in word else plain).append(word)
        for group, ids in self._together(letters, " "):
            cuts = np.flatnonzero(self._ends[ids]) + 1
            if len(cuts) == len(group):
                self._keep(group, ids, cuts, 0)
            else:
                (plain if self._border is not None else alone).extend(group)
        for word, ids in zip(alone, self._raw(alone), strict=True):
            self._known[word] = ids.tobytes()
        for group, ids in self._together(plain, f" {_BORDER} "):
            self._keep(group, ids, np.append(np.flatnonzero(ids == self._border), len(ids)), 1)

    def _together(self, words: list[str], between: str) -> Iterable[tuple[list[str], np.ndarray]]:
        groups = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        return zip(groups, self._raw([between.join(g) for g in groups]), strict=True)

    def _keep(self, words: list[str], ids: np.ndarray, cuts: np.ndarray, skipped: int) -> None:
        """The ids of each word end at its cut, and those of the next begin ``skipped`` ids behind."""
        data, start = ids.tobytes(), 0
        for word, cut in zip(words, (4 * cuts).tolist(), strict=True):
            self._known[word] = data[start:cut]
            start = cut + 4 * skipped

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of words, known or not."""
        found = list(map(self._known.get, words))
        absent = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for word in dict.fromkeys(map(words.__getitem__, absent)):
            ids = self._before.get(word)
            if ids is None:
                new.append(word)
            else:
                self._known[word] = ids
        self._learn(new)
        for i in absent:
            found[i] = self._known[words[i]]
        for word in new:
            if len(word) > LONGEST_WORD:
                del self._known[word]
        if len(self._known) > self._max_words // 2:
            self._before, self._known = self._known, {"": b""}
        return found

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        data, starts, first = cut_words(texts)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        ends = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        words = words.dictionary_encode()
        # As one text that is split again, which is faster than word by word.
        plain = pc.ascii_ltrim(words.dictionary, characters=" ")
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")
        known = self._ids(joined[0].as_py().split(" "))
        _, offsets, values = pa.array(known, pa.large_binary()).take(words.indices).buffers()
        ends = np.frombuffer(offsets, "<i8")[: len(starts) + 1] // 4
        return np.frombuffer(values, "<u4")[: ends[-1]] if values else np.zeros(0, "<u4"), np.diff(ends[first])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, lengths = self.flat(pa.array(texts, pa.string()))
        ends, data = (4 * np.cumsum(lengths)).tolist(), ids.tobytes()
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def cut_words(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of all texts, where words begin in them, and the first word of each text, with that after the last.

    A word begins with the blank before it, if there is one; a line end becomes a blank.
    """
    _, offsets, held = texts.buffers()
    if held is None or not len(texts):
        return b"", np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(offsets, "<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = held[ends[0] : ends[-1]].to_pybytes().replace(b"\n", b" ")
    ends -= ends[0]
    values = np.frombuffer(data, np.uint8)
    blank = values == _BLANK
    begins = blank.copy()
    borders = ends[ends < len(data)]
    # No mark has a text's border beside it.
    mark = np.zeros(len(data), bool)
    if len(data) > 2:
        mark[1:-1] = _IS_MARK[values[1:-1]] & _BEFORE_MARK[values[:-2]] & blank[2:]
        mark[borders] = mark[borders[borders > 0] - 1] = False
    begins |= mark
    begins[borders] = True
    starts = np.flatnonzero(begins)
    return data, starts, np.searchsorted(starts, ends)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encoder(path: str | None = None, max_words: int = MAX_WORDS) -> Encoder:
    """The encoder of this worker process; ``path`` defaults to the public tokenizer named above."""
    path = path or default_path()
    if (path, max_words) not in _encoders:
        _encoders[path, max_words] = Encoder(path, max_words)
    return _encoders[path, max_words]


def forget() -> bool:
    """Drop the encoders of this worker process, for a step that needs none; whether there were any."""
    there = bool(_encoders)
    _encoders.clear()
    return there
