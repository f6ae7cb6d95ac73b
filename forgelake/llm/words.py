"""Words of a text as 64-bit hashes, and hashes of word n-grams.

A word is a run of letters, digits and underscores, in lower case. All words of a text are hashed at once, from
its code points: a polynomial in the code points of the word, from running sums, so nothing is kept between texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

WORD = re.compile(r"\w+")
# Code points that are hashed at once, about; a longer word than that is still one word.
SLICE = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_NOT_WORD = re.compile(r"\W")
_in_words: np.ndarray | None = None
_powers = np.ones(1, np.uint64)


def _is_word() -> np.ndarray:
    """For each code point whether it belongs to words."""
    global _in_words
    if _in_words is None:
        _in_words = np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)
    return _in_words


def _powers_to(n: int) -> np.ndarray:
    """Powers of the base up to the n-th at least."""
    global _powers
    if len(_powers) <= n:
        factors = np.full(1 << n.bit_length(), _BASE, np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MULTIPLIER
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def _hashes(lowered: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a lower-case text, and where each begins."""
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _is_word()[points]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    powers = _powers_to(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)], out=total[1:])
    # Brought to one power, whatever the place.
    value = (total[ends] - total[starts]) * powers[len(points) - starts]
    # The powers left over from the length of the text cancel out, since the base is odd.
    value = value * np.uint64(pow(_BASE, -len(points), 1 << 64))
    return mix(value + (ends - starts).astype(np.uint64) * _MULTIPLIER), starts


def _slices(lowered: str) -> Iterator[str]:
    start = 0
    while len(lowered) - start > SLICE:
        border = _NOT_WORD.search(lowered, start + SLICE)
        if not border:
            break
        yield lowered[start : border.start()]
        start = border.start()
    yield lowered[start:] if start else lowered


def word_hashes(text: str) -> np.ndarray:
    lowered = text.lower()
    if len(lowered) <= SLICE:
        return _hashes(lowered)[0]
    return np.concatenate([_hashes(part)[0] for part in _slices(lowered)])


def texts_hashes(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of several texts one after another, and how many words each has; a few texts at a time."""
    held, size = [], 0

    def take():
        ends = np.cumsum([len(t) + 1 for t in held])
        hashes, starts = _hashes("\n".join(held))
        return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)

    for text in texts:
        lowered = text.lower()
        if held and size + len(lowered) > SLICE:
            yield take()
            held, size = [], 0
        if len(lowered) > SLICE:
            hashes = np.concatenate([_hashes(part)[0] for part in _slices(lowered)])
            yield hashes, np.array([len(hashes)])
        else:
            held.append(lowered)
            size += len(lowered)
    if held:
        yield take()


def each_text(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text."""
    for words, counts in texts_hashes(texts):
        end = 0
        for n in counts.tolist():
            yield words[end : end + n]
            end += n


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words; none if there are fewer."""
    width = len(words) - n + 1
    if width <= 0:
        return np.zeros(0, np.uint64)
    value = np.full(width, np.uint64(n))
    for j in range(n):
        value = value * np.uint64(0x100000001B3) + words[j : j + width]
    return mix(value)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """As ``ngram_hashes``, but a text of fewer than ``n`` words has one shingle: all of them."""
    return ngram_hashes(words, min(n, len(words))) if len(words) else np.zeros(0, np.uint64)
