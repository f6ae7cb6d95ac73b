"""Byte-level BPE by a finite-state transducer, and its decoding as a stream (operator 12).

**Encoding.** Merging pairs by rank cuts a piece of text so that no two neighbours would have merged across
their border; and a cut in which no two neighbours would is the one that merging makes. So a transducer can
read bytes from left to right without merging anything: it holds a thread for each suffix of what it has read
that begins some token. A thread is the token before that suffix and the suffix's place in the tree of tokens.
With each byte, exactly one thread ends a token that stands next to its predecessor: that token is the step's
output, and begins the next thread. The sets of threads are the states of the subset construction. A step between
states is made when texts have needed it more than once, and kept; a text that no step leads on is followed by its
threads alone, which costs less than making states that nothing comes back to. Of the outputs, those on the path that all threads
share are emitted: how far that lies behind is bounded by the longest tokens. Short pieces are read side by side: each as
far as steps lead, then the threads of all of them together, in arrays.

Whether two tokens can be neighbours follows from the merges along their common border: the pieces at it, and
the ranks at which each is merged away from it.

A text is split by the pattern first. A piece that is a token is that token; others run through the transducer.
Words repeat, so each worker remembers what short ones gave: a run of blanks with what follows it is split on its
own, since a run of white space begins a piece whatever is before it. Texts are cut into words as bytes, about one
MB of them at once, and a word that is repeated there is looked up once.

**Decoding.** The bytes of tokens are joined, and a state machine over UTF-8 follows token by token, in a table
of (state, token) that fills as it is used. What is given out always ends at the end of a character, also where
tokens, or calls, end within one. Malformed bytes end where a decoder would replace them.

Nothing is shuffled. All tables are bounded and start again when they are full.

Defined results: a NULL or empty text has no ids; a NULL or empty array of ids is an empty text. Special tokens in a
text are ordinary text. Repeated rows stay. Other columns pass through, and names drawn here avoid theirs. A
text of any length is split in slices. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgelake.llm.common import free_name, map_batches, prepare, text_or_empty

RANKS = "byte_bpe_multi_50k.tiktoken"
# Words and pieces a worker remembers, some 200 bytes each, and the longest of them in bytes.
MAX_KNOWN = 600_000
LONGEST_KNOWN = 48
# States, pairs of tokens and (state, token) steps that are kept.
MAX_STATES = 40_000
MAX_PAIRS = 300_000
MAX_STEPS = 400_000
# How often a step between states is needed until it is made: by a piece that is read alone, and by pieces side by side,
# whose threads cost less.
WORTH_ALONE = 2
WORTH_TOGETHER = 32
# Places, as a power of two, for pairs of tokens that are looked up many at once; a pair takes the place of an older one.
PLACES = 21
# Bytes of a piece after which the transducer emits what is sure.
EMIT_EVERY = 64
# Characters of a text that are split at once, about, bytes of texts that are encoded at once, and ids that are
# decoded at once.
SLICE = 1 << 20
GROUP = 1 << 20
IDS_AT_ONCE = 1 << 16
_NEVER = 1 << 62
_NONE = -1


class State:
    """The threads a text so far leaves, longest suffix first: token before the suffix, and the suffix's node."""

    __slots__ = ("threads", "steps")

    def __init__(self, threads: tuple[tuple[int, int], ...]):
        self.threads = threads
        # For each byte the token that ends with it, and the state after it; before that, how often it was needed.
        self.steps: dict[int, tuple[int, State] | int] = {}


class Transducer:
    """Reads the bytes of a piece and gives the ids that merging by rank gives."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self._sizes = {i: len(t) for t, i in ranks.items()}
        # The tree of tokens: children by (node, byte), and for each node its token and depth, and if it has children.
        self._children: dict[int, int] = {}
        self._token, self._depth, self._inner = [_NONE], [0], [True]
        for token, number in ranks.items():
            node = 0
            for byte in token:
                self._inner[node] = True
                key = node << 8 | byte
                node = self._children.setdefault(key, len(self._token))
                if node == len(self._token):
                    self._token.append(_NONE)
                    self._depth.append(self._depth[key >> 8] + 1)
                    self._inner.append(False)
            self._token[node] = number
        self._borders: dict[int, tuple | None] = {}
        self._pairs: dict[int, bool] = {}
        self._max_states = max_states
        self._make_arrays()
        self._restart()

    def _make_arrays(self) -> None:
        """The tree as arrays, and room for pairs. Most nodes have one child; those with more have a row of children."""
        keys = np.fromiter(self._children, np.int64, len(self._children))
        nodes = np.fromiter(self._children.values(), np.int32, len(keys))
        parents, by = keys >> 8, keys & 255
        counts = np.bincount(parents, minlength=len(self._token))
        one = counts[parents] == 1
        self._is_inner = counts > 0
        self._only_byte = np.full(len(counts), _NONE, np.int16)
        self._only_child = np.full(len(counts), _NONE, np.int32)
        self._only_byte[parents[one]], self._only_child[parents[one]] = by[one], nodes[one]
        self._row = np.where(counts > 1, np.cumsum(counts > 1), 0).astype(np.int32)
        self._grid = np.full((self._row.max() + 1, 256), _NONE, np.int32)
        self._grid[self._row[parents[~one]], by[~one]] = nodes[~one]
        self._tokens_at = np.array(self._token, np.int32)
        self._lengths = np.zeros(max(self._sizes, default=0) + 1, np.int64)
        self._lengths[list(self._sizes)] = list(self._sizes.values())
        self._pair_at = np.full(1 << PLACES, _NONE, np.int64)
        self._fits_at = np.zeros(1 << PLACES, bool)

    def _restart(self) -> None:
        self.start = State(((_NONE, 0),))
        self._states = {self.start.threads: self.start}

    def merge(self, data: bytes) -> tuple[list[bytes], list, list]:
        """Parts after all merges, and what stood at the left and the right border until which rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        left, right = [], []
        while True:
            best, at = _NEVER, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], _NEVER)
                if rank < best:
                    best, at = rank, i
            if at == 0 or at < 0:
                left.append((parts[0], best))
            if at == len(parts) - 2 or at < 0:
                right.append((parts[-1], best))
            if at < 0:
                return parts, left, right
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _border(self, token: int) -> tuple[list, list] | None:
        """The borders of a token; none if merging its bytes gives something else."""
        if token not in self._borders:
            parts, left, right = self.merge(self.tokens[token])
            self._borders[token] = (left, right) if len(parts) == 1 else None
        return self._borders[token]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging leaves ``b`` next to ``a``, or alone where ``a`` is none."""
        key = (a + 1) << 32 | b
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self._neighbours(a, b)
        return found

    def _neighbours(self, a: int, b: int) -> bool:
        if self._border(b) is None:
            return False
        if a == _NONE:
            return True
        right, left = self._border(a)[1], self._border(b)[0]
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = right[i], left[j]
            across = self.ranks.get(x + y, _NEVER)
            # Of equal ranks the one further left is merged first.
            if across < until_x and across <= until_y and across < _NEVER:
                return False
            if until_x == until_y == _NEVER:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def _follow(self, threads: Iterable[tuple[int, int]], data: bytes, ended: list[int]) -> list[tuple[int, int]]:
        """Follow threads through ``data``, and those that begin within it, one after another, longest suffix first. Adds
        to ``ended`` the token that ends with each byte, and gives the threads that are left."""
        children, tokens, inner, pairs = self._children, self._token, self._inner, self._pairs
        found, left, size = [_NONE] * len(data), [], len(data)
        given = list(threads)
        first = len(given) - 1
        for number in range(first + size + 1):
            if number <= first:
                last, node = given[number]
                at = 0
            else:
                # All threads that can end a token here have been followed.
                at = number - first
                last, node = found[at - 1], 0
                if last < 0:
                    raise ValueError(f"byte {data[at - 1]} has no token")
            while at < size:
                node = children.get(node << 8 | data[at])
                if node is None:
                    break
                token = tokens[node]
                if token >= 0 and found[at] < 0:
                    fits = pairs.get((last + 1) << 32 | token)
                    if fits or (fits is None and self.neighbours(last, token)):
                        found[at] = token
                at += 1
            else:
                if inner[node]:
                    left.append((last, node))
        ended += found
        return left

    def _fit(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """``neighbours`` of many pairs."""
        keys = (before.astype(np.int64) + 1) << 32 | tokens
        places = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACES)).astype(np.int64)
        fits = self._fits_at[places]
        absent = np.flatnonzero(self._pair_at[places] != keys)
        if len(absent):
            new, at = np.unique(keys[absent], return_inverse=True)
            found = np.array([self._neighbours((key >> 32) - 1, key & 0xFFFFFFFF) for key in new.tolist()])[at]
            fits[absent] = found
            # One after another, so that a place has a pair and what was found for it, also if two pairs share it.
            places, last = np.unique(places[absent], return_index=True)
            self._pair_at[places], self._fits_at[places] = keys[absent][last], found[last]
        return fits

    def _follow_all(self, given: Sequence[Sequence[tuple[int, int]]], rests: Sequence[bytes]) -> np.ndarray:
        """As ``_follow``, for many pieces side by side: the tokens that end with each byte of all of them."""
        data = np.frombuffer(b"".join(rests), np.uint8)
        sizes = np.array([len(r) for r in rests])
        ends = np.cumsum(sizes)
        begins, size = ends - sizes, len(data)
        more = np.ones(size, bool)
        more[ends - 1] = False
        # Threads: the place of their next byte, their node, and where the token before them is found: at a place, or
        # behind all places if it was given.
        begun = np.flatnonzero(more) + 1
        counts = np.array([len(threads) for threads in given])
        before, nodes = np.array(list(chain.from_iterable(given)), np.int64).reshape(-1, 2).T
        at = np.concatenate([np.repeat(begins, counts), begun])
        node = np.concatenate([nodes, np.zeros(len(begun), np.int64)])
        source = np.concatenate([np.arange(size, size + len(nodes)), begun - 1])
        where, tokens, sources = [], [], []
        while len(at):
            child = self._grid[self._row[node], data[at]]
            one = np.flatnonzero(self._only_byte[node] == data[at])
            child[one] = self._only_child[node[one]]
            node = child
            on = np.flatnonzero(node >= 0)
            at, node, source = at[on], node[on], source[on]
            token = self._tokens_at[node]
            ends_here = np.flatnonzero(token >= 0)
            where.append(at[ends_here])
            tokens.append(token[ends_here])
            sources.append(source[ends_here])
            on = np.flatnonzero(more[at] & self._is_inner[node])
            at, node, source = at[on] + 1, node[on], source[on]
        where, tokens, sources = map(np.concatenate, (where, tokens, sources))
        # By the distance from the piece's begin, for what is found at a place depends on the places before it.
        distance = where - np.repeat(begins, sizes)[where]
        order = np.argsort(distance, kind="stable")
        where, tokens, sources = where[order], tokens[order], sources[order]
        found = np.concatenate([np.full(size, _NONE), before])
        start = 0
        for stop in np.cumsum(np.bincount(distance)).tolist():
            fits = np.flatnonzero(self._fit(found[sources[start:stop]], tokens[start:stop])) + start
            found[where[fits]] = tokens[fits]
            start = stop
        found = found[:size]
        if size and found.min() < 0:
            raise ValueError(f"byte {data[found.argmin()]} has no token")
        return found

    def _step(self, state: State, byte: int) -> tuple[int, State]:
        ended: list[int] = []
        reached = tuple(self._follow(state.threads, bytes((byte,)), ended))
        after = self._states.get(reached)
        if after is None:
            if len(self._states) >= self._max_states:
                self._restart()
            after = self._states[reached] = State(reached)
        state.steps[byte] = ended[0], after
        return ended[0], after

    def _lead(self, data: bytes, state: State, ended: list[int], worth: int) -> tuple[int, State]:
        """How many bytes steps lead on from ``state``, and the state they lead to; adds to ``ended`` as they do. Steps
        that were needed ``worth`` times are made."""
        for at, byte in enumerate(data):
            step = state.steps.get(byte, 0)
            if type(step) is int:
                if step + 1 < worth:
                    state.steps[byte] = step + 1
                    return at, state
                step = self._step(state, byte)
            token, state = step
            ended.append(token)
        return len(data), state

    def _read(self, data: bytes, threads: State | Sequence[tuple[int, int]], ended: list[int]) -> State | Sequence[tuple[int, int]]:
        """Add to ``ended`` the token that ends with each byte; the state, or the threads, after the last one."""
        if not isinstance(threads, State):
            return self._follow(threads, data, ended)
        at, state = self._lead(data, threads, ended, WORTH_ALONE)
        return state if at == len(data) else self._follow(state.threads, data[at:], ended)

    def _path(self, ended: list[int], stop: int) -> list[int]:
        """The tokens that lead to the place ``stop``; ``ended`` has the token that ends at each place from 1."""
        path = []
        while stop:
            path.append(ended[stop - 1])
            stop -= self._sizes[path[-1]]
        return path[::-1]

    def emit(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of one piece, as soon as no further byte can change them; checked every ``EMIT_EVERY`` bytes."""
        state, ended, data = self.start, [], iter(data)
        while part := bytes(islice(data, EMIT_EVERY)):
            state = self._read(part, state, ended)
            threads = state.threads if isinstance(state, State) else state
            # Where the paths of all threads meet.
            places = {len(ended) - self._depth[node] for _, node in threads}
            while len(places) > 1:
                last = max(places)
                places.remove(last)
                places.add(last - self._sizes[ended[last - 1]])
            sure = places.pop()
            yield from self._path(ended, sure)
            del ended[:sure]
        yield from self._path(ended, len(ended))

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > EMIT_EVERY:
            return list(self.emit(data))
        ended: list[int] = []
        self._read(data, self.start, ended)
        return self._path(ended, len(ended))

    def pieces(self, many: Sequence[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit; none is empty."""
        numbers = list(map(self.ranks.get, many))
        out = [b"" if n is None else n.to_bytes(4, "little") for n in numbers]
        short = []
        for i, number in enumerate(numbers):
            if number is None and len(many[i]) > EMIT_EVERY:
                out[i] = np.fromiter(self.emit(many[i]), "<u4").tobytes()
            elif number is None:
                short.append(i)
        ended: list[int] = []
        places, given, rests = [], [], []
        for data in map(many.__getitem__, short):
            at, state = self._lead(data, self.start, ended, WORTH_TOGETHER)
            if at < len(data):
                rests.append(data[at:])
                given.append(state.threads)
                places.append(len(ended))
                ended += [_NONE] * len(rests[-1])
        found = np.array(ended, np.int64)
        if rests:
            sizes = np.array([len(r) for r in rests])
            shift = np.array(places) - np.cumsum(sizes) + sizes
            found[np.arange(sizes.sum()) + np.repeat(shift, sizes)] = self._follow_all(given, rests)
        # Back along the paths of all pieces at once.
        sizes = np.array([len(many[i]) for i in short], np.int64)
        ends = np.cumsum(sizes)
        at, begins, used = ends, ends - sizes, np.zeros(len(found) + 1, np.int64)
        while len(at):
            used[at] = 1
            at = at - self._lengths[found[at - 1]]
            on = np.flatnonzero(at > begins)
            at, begins = at[on], begins[on]
        ids = found[used[1:] > 0].astype("<u4").tobytes()
        start = 0
        for i, stop in zip(short, (4 * np.cumsum(used)[ends]).tolist(), strict=True):
            out[i], start = ids[start:stop], stop
        return out


# A run of white space begins a piece, whatever is before it; so a text may be cut there.
_CUT = regex.compile(r"(?<=\S)\s")
# The blanks that are common, and white space of any other kind.
_BLANKS = b" \t\n\r"
_IS_BLANK = np.array([b in _BLANKS for b in range(256)])
_OTHER_BLANKS = regex.compile(r"[^\S \t\n\r]")


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of a text that are split apart from one another."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self._split = regex.compile(pattern).findall
        blocks = ("".join(map(chr, range(i, i + 4096))) for i in range(0, sys.maxunicode, 4096))
        others = chain.from_iterable(map(_OTHER_BLANKS.findall, blocks))
        self._other_blank = re.compile(b"|".join(re.escape(c.encode()) for c in others)).search
        # What words and pieces gave. When half of the room is full, they start again and keep what is asked for once more.
        self._known: dict[bytes, bytes] = {}
        self._before: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Of distinct words that are not known, those that are not known from before either; their ids go to the known."""
        known, before, new = self._known, self._before, []
        for word in words:
            ids = before.get(word)
            if ids is None:
                new.append(word)
            else:
                known[word] = ids
        return new

    def _pieces(self, words: list[bytes]) -> dict[bytes, list[bytes]]:
        """The pieces of each word. Words that begin with a blank and do not end with white space are split as one text."""
        pieces, joined, texts = {}, [], []
        for word in words:
            text = word.decode()
            if text[0] in " \t\n\r" and not text[-1].isspace():
                joined.append(word)
                texts.append(text)
            else:
                pieces[word] = [p.encode() for p in self._split(text)]
        found = self._split("".join(texts))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        wanted = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cuts = np.searchsorted(ends, wanted) + 1
        if len(joined) and (cuts[-1] > len(ends) or (ends[cuts - 1] != wanted).any()):
            # The pattern leaves something out.
            return pieces | {w: [p.encode() for p in self._split(t)] for w, t in zip(joined, texts, strict=True)}
        start = 0
        for word, cut in zip(joined, cuts.tolist(), strict=True):
            pieces[word] = [word] if cut - start == 1 else [p.encode() for p in found[start:cut]]
            start = cut
        return pieces

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, known or not."""
        known = self._known
        found = list(map(known.get, words))
        absent = [i for i, ids in enumerate(found) if ids is None]
        new = self._learn([words[i] for i in absent])
        # Words are kept beside pieces: most are one, and a piece on its own is split to itself.
        cut = self._pieces(new)
        pieces = self._learn([p for p in dict.fromkeys(chain.from_iterable(cut.values())) if p not in known])
        known.update(zip(pieces, self.transducer.pieces(pieces), strict=True))
        for word, parts in cut.items():
            if parts != [word]:
                known[word] = b"".join(map(known.__getitem__, parts))
        for i in absent:
            found[i] = known[words[i]]
        for word in chain(new, pieces):
            if len(word) > LONGEST_KNOWN:
                known.pop(word, None)
        if len(known) > MAX_KNOWN // 2:
            self._before, self._known = known, {}
        return found

    def _together(self, data: bytes, ends: np.ndarray) -> list[bytes]:
        """The ids of texts whose bytes lie in ``data`` one after another; ``ends`` begins with 0."""
        blank = _IS_BLANK[np.frombuffer(data, np.uint8)]
        # A word is a run of blanks with what follows it, or what a text begins with.
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[ends[ends < len(data)]] = True
        if self._other_blank(data):
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if self._other_blank(data, start, end):
                    sizes = [len(p.encode()) for p in self._split(data[start:end].decode())]
                    # A text of which the pattern leaves something out is one word.
                    begins[start:end] = False
                    begins[start + np.cumsum([0, *sizes[:-1]] if sum(sizes) == end - start else [0])] = True
        starts = np.flatnonzero(begins)
        if not len(starts):
            return [b""] * (len(ends) - 1)
        offsets = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        words = words.dictionary_encode()
        _, offsets, held = words.dictionary.buffers()
        stops, held = np.frombuffer(offsets, "<i4")[: len(words.dictionary) + 1].tolist(), held.to_pybytes()
        ids = self._ids([held[i:j] for i, j in zip(stops, stops[1:], strict=False)])
        _, offsets, held = pa.array(ids, pa.large_binary()).take(words.indices).buffers()
        stops = np.frombuffer(offsets, "<i8")[np.searchsorted(starts, ends)].tolist()
        held = held.to_pybytes() if held else b""
        return [held[i:j] for i, j in zip(stops, stops[1:], strict=False)]

    def encode(self, text: str) -> bytes:
        parts = (part.encode() for part in slices(text))
        return b"".join([self._together(part, np.array([0, len(part)]))[0] for part in parts])

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; some are encoded together, and one that is longer in slices."""
        texts = texts.cast(pa.large_string())
        _, offsets, held = texts.buffers()
        ends = np.frombuffer(offsets, "<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        out: list[bytes] = []
        while (start := len(out)) < len(texts):
            stop = int(np.searchsorted(ends, ends[start] + GROUP, "right")) - 1
            if stop <= start:
                out.append(self.encode(texts[start].as_py()))
            else:
                data = held[ends[start] : ends[stop]].to_pybytes() if held else b""
                out += self._together(data, ends[start : stop + 1] - ends[start])
        return out


# Bytes that may follow in each state, and the state after them. 0 is the end of a character; 1 to 3 bytes
# that may be any are missing in 1 to 3; in 4 to 7 the next byte is limited.
_FOLLOWS = {
    1: (0x80, 0xBF, 0),
    2: (0x80, 0xBF, 1),
    3: (0x80, 0xBF, 2),
    4: (0xA0, 0xBF, 1),
    5: (0x80, 0x9F, 1),
    6: (0x90, 0xBF, 2),
    7: (0x80, 0x8F, 2),
}
_LEADS = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
          (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]


def utf8_step(state: int, byte: int) -> tuple[int, bool]:
    """The state after a byte, and whether a character, whole or malformed, ended before the byte."""
    if state:
        low, high, after = _FOLLOWS[state]
        if low <= byte <= high:
            return after, False
    for low, high, after in _LEADS:
        if low <= byte <= high:
            return after, True
    return 0, True


class _Steps(dict):
    """From one state, for each token the state after it and its bytes after the last border between characters,
    or less the number of all its bytes if there is none."""

    def __init__(self, state: int, tokens: dict[int, bytes]):
        super().__init__()
        self._state, self._tokens = state, tokens

    def __missing__(self, token: int) -> tuple[int, int]:
        state, data, border = self._state, self._tokens[token], -1
        for i, byte in enumerate(data):
            state, before = utf8_step(state, byte)
            if state == 0:
                border = i + 1
            elif before:
                border = i
        if len(self) >= MAX_STEPS // 8:
            self.clear()
        found = self[token] = state, (len(data) - border if border >= 0 else -len(data))
        return found


class Tables:
    """Bytes of tokens and the steps of the state machine, shared by all streams of a worker."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.steps = [_Steps(state, tokens) for state in range(8)]
        # Tokens that lead from the end of a character to the end of a character, whole or malformed.
        self.whole = np.zeros(max(tokens, default=-1) + 1, bool)
        for token in tokens:
            self.whole[token] = self.steps[0].__missing__(token) == (0, 0)
        self.steps[0].clear()


class StreamDecoder:
    """Gives out the bytes of ids, always up to the end of a character."""

    def __init__(self, tables: Tables):
        self._tables = tables
        self._state, self._held = 0, b""

    def feed(self, ids: np.ndarray | Sequence[int]) -> bytes:
        ids = np.asarray(ids, np.int64)
        listed = ids.tolist()
        state, held, steps = self._state, len(self._held), self._tables.steps
        # Between two characters, what begins and ends with whole ones changes nothing: on to the next other token.
        others = np.flatnonzero(~self._tables.whole[ids]).tolist()
        others.append(len(listed))
        at = following = 0
        while True:
            if not state:
                held = 0
                while others[following] < at:
                    following += 1
                at = others[following]
            if at == len(listed):
                break
            state, tail = steps[state][listed[at]]
            held = tail if tail >= 0 else held - tail
            at += 1
        data = self._held + b"".join(map(self._tables.tokens.__getitem__, listed))
        self._state, self._held = state, data[len(data) - held :]
        return data[: len(data) - held]

    def finish(self) -> bytes:
        """What is left of a character that never ended."""
        rest, self._state, self._held = self._held, 0, b""
        return rest


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_encoders: dict[tuple[str, str], Encoder] = {}
_tables: dict[str, Tables] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
        # The tables stay for good: the collector need not look through them again and again.
        gc.collect()
        gc.freeze()
        gc.set_threshold(100_000, 50, 100)
    return _encoders[path, pattern]


def tables(path: str) -> Tables:
    if path not in _tables:
        _tables[path] = Tables({i: t for t, i in read_ranks(path).items()})
    return _tables[path]


def encode(
    docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, path: str | None = None, pattern: str | None = None
) -> tuple[DataFrame, str]:
    """The columns ``keep`` (all) with a column of ids, as little-endian unsigned 32-bit, and that column's name."""
    prepare(docs.sparkSession)
    path, pattern = path or default_path(), pattern or default_pattern()
    keep = docs.columns if keep is None else keep
    column, text = free_name("ids", keep), free_name("_text", keep)
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), text_or_empty(text_col).alias(text))

    def run(batches) -> Iterator[dict[str, list]]:
        to_ids = encoder(path, pattern).encode_all
        for batch in batches:
            *kept, texts = batch.columns
            yield {**dict(zip(keep, kept, strict=True)), column: to_ids(texts)}

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(column, T.BinaryType())])
    return map_batches(rows, run, schema), column


def decode(encoded: DataFrame, ids_col: str, *, path: str | None = None, as_text: bool = False) -> tuple[DataFrame, str]:
    """The other columns of ``encoded`` with the bytes that the ids stand for, or the text, in which what is malformed
    is replaced by U+FFFD; and the name of that column."""
    prepare(encoded.sparkSession)
    path = path or default_path()
    keep = [c for c in encoded.columns if c != ids_col]
    column = free_name("text" if as_text else "decoded", keep)
    rows = encoded.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids_col}`"))

    def run(batches) -> Iterator[dict[str, list]]:
        known = tables(path)
        for batch in batches:
            *kept, texts = batch.columns
            out = []
            for data in texts:
                ids = np.frombuffer(data.as_py() or b"", "<u4")
                stream = StreamDecoder(known)
                parts = [stream.feed(ids[i : i + IDS_AT_ONCE]) for i in range(0, len(ids), IDS_AT_ONCE)]
                parts.append(stream.finish())
                # Parts end with characters, so each can be decoded on its own.
                out.append("".join([p.decode("utf-8", "replace") for p in parts]) if as_text else b"".join(parts))
            yield {**dict(zip(keep, kept, strict=True)), column: pa.array(out, pa.string() if as_text else pa.binary())}

    kind = T.StringType() if as_text else T.BinaryType()
    return map_batches(rows, run, T.StructType([*(rows.schema[c] for c in keep), T.StructField(column, kind)])), column


def digests(docs: DataFrame, keep: list[str], **options) -> DataFrame:
    """``keep`` with the number and the digest of the ids of each text, and the digest of what they decode to."""
    encoded, ids = encode(docs, keep=keep, **options)
    counted = encoded.select(
        *(F.col(f"`{c}`") for c in keep),
        (F.octet_length(F.col(ids)) / 4).cast("bigint").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        ids,
    )
    decoded, data = decode(counted, ids)
    return decoded.select(*keep, "n_tokens", "ids_sha256", F.sha2(F.col(data), 256).alias("decoded_sha256"))
