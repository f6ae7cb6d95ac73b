"""Phrases whose words occur together more often than apart, by prefix-free parsing (operator 13).

1. Texts are read as words and ends of pieces (punctuation and line ends). A window of ``overlap`` words whose hash is
   divisible by ``SPACING`` is a trigger: a chunk ends with it and the next one begins with it. So chunks overlap by
   the words of the trigger, and equal passages give equal chunks wherever they stand.
2. The dictionary of the parse: each distinct chunk per language, whether a text ends with it, and how often the
   parse has it. Copies of texts cost nothing from here on.
3. Runs of up to ``MAX_WORDS`` words are counted inside distinct chunks, times the chunk's frequency. A run
   belongs to the chunk that it begins in before the trigger, so that those in an overlap count once; it
   always ends within that chunk. No run goes over the end of a piece.
4. A run can only reach ``min_count`` if the shorter runs within it do, so runs are counted only where all their runs of up
   to ``KEYED_WORDS`` words may be frequent. Most runs are rare, and are never moved as text: every task sends a 32-bit
   key of each word, then of each pair of words that may be frequent, then of each three words whose pairs may be, and how
   often it has it, as sorted steps of about two bytes. Runs of one key are added up together, so a sum is never too low.
   What may be frequent is known from bit tables of at most ``MAX_BITS``: a wrong bit costs a count that is not needed, and
   is never missed. The runs left are counted exactly, all lengths at once. Every task adds up its own counts before the
   shuffle.
5. Candidates, their parts and the longer candidates around them are joined by phrase. All parts of a candidate are
   frequent themselves. Scores are computed with decimals of 38 digits.

Chunks and runs are slices of the bytes they stand in, found by numpy over many texts at once. Within a task, runs
are told apart by a 64-bit hash and, beside it, by their length and the sum of their squared bytes.

Defined results: a NULL or empty text has no words; a NULL language is ``und``. Repeated rows, also of one id, count each
time. Only A to Z are lowered. An empty table gives no rows. Other columns are not read. Texts of any length are
parsed in slices that end between pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelake.llm.common import map_batches, prepare, text_or_empty
from forgelake.llm.words import mix
from forgelake.session import materialize

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
UNKNOWN = "und"
# Words from one trigger to the next, on average.
SPACING = 32
# Bytes that a task reads at once, about, and the rows it gives out at once.
HELD_BYTES = 6 << 20
ROWS_AT_ONCE = 1 << 16
# Bits per frequent run, and the most bits, of a table that tells which runs may be frequent.
BITS_PER_RUN = 32
MAX_BITS = 1 << 28
# Words of the longest runs that are added up by keys first.
KEYED_WORDS = 3
# Ranges that keys of runs are dealt by, and the keys that a task holds before it sends or adds them up.
KEY_BITS, RANGE_BITS = 32, 22
KEYS_AT_ONCE = 1 << 20
# Bytes of a text that are parsed at once, about.
SLICE = 1 << 20
# What ends a piece.
_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_BLANKS = re.compile(rb"  +")
# A to Z lowered, all ends of pieces one sign and both blanks one.
_END, _BLANK = ord("."), ord(" ")
_PLAIN = bytes(
    _END if chr(b) in ".,;:!?\n\x0b\x0c\r" else _BLANK if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_IN_WORDS = np.array([b not in (_END, _BLANK) for b in range(256)])
_BASE = 0x2545F4914F6CDD1D
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNKS = "lang string, chunk binary, last boolean, words long"
_COUNTS = "lang string, phrase binary, words int, n long"
_KEYS = "range int, steps binary, counts binary"
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) <= n:
        factors = np.full(1 << n.bit_length(), _BASE, np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers


class Words:
    """The words in a stretch of bytes. ``breaks`` are places where a word ends whatever stands there, as between chunks."""

    def __init__(self, data: bytes | np.ndarray, breaks: np.ndarray | None = None):
        self.data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        size = len(self.data)
        inside = np.zeros(size + 2, bool)
        inside[1:-1] = _IN_WORDS[self.data]
        begin, end = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        if breaks is not None:
            # Between two bytes of words.
            breaks = breaks[inside[breaks] & inside[breaks + 1]]
            begin[breaks] = end[breaks] = True
        self.starts, self.stops = np.flatnonzero(begin), np.flatnonzero(end)
        ends = np.zeros(size + 1, np.int64)
        np.cumsum(self.data == _END, out=ends[1:])
        # Pieces are numbered by the signs before them, and apart by breaks.
        piece = ends[self.starts]
        if breaks is not None and len(breaks):
            piece = piece + np.searchsorted(breaks, self.starts, "right")
        self.piece = piece

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word, and a second number that tells words apart."""
        size = len(self.data)
        powers, wide = _powers_to(size + 1), self.data.astype(np.uint64)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((wide + np.uint64(1)) * powers[:size], out=total[1:])
        # Brought to one power, whatever the place; the base is odd, so what that leaves over cancels out.
        value = (total[self.stops] - total[self.starts]) * powers[size - self.starts]
        value = mix(value * np.uint64(pow(_BASE, -size, 1 << 64)) + (self.stops - self.starts).astype(np.uint64))
        np.cumsum(wide * wide, out=total[1:])
        lengths = (self.stops - self.starts).astype(np.uint64)
        return value, (total[self.stops] - total[self.starts]) * np.uint64(1 << 20) + lengths


def _slices(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    start = 0
    while len(data) - start > size:
        end = _ENDS.search(data, start + size)
        if not end:
            break
        yield data[start : end.start()]
        start = end.start()
    yield data[start:] if start else data


def plain(text: str) -> bytes:
    """The bytes of a text with one sign for all ends of pieces, and single blanks."""
    data = text.encode().translate(_PLAIN)
    return _BLANKS.sub(b" ", data) if b"  " in data else data


def chunks_of(texts: list[bytes], overlap: int, spacing: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Chunks of plain texts: number of the text, bytes, whether the text ends with it, and how many words are its own."""
    data = b".".join(texts)
    words = Words(data)
    if not len(words):
        none = np.zeros(0, np.int64)
        return none, [], none.astype(bool), none
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text = np.searchsorted(np.cumsum(sizes), words.starts, "right")
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    starts = first
    width = len(words) - overlap + 1
    if overlap and width > 0:
        value, window = words.hashes()[0], np.zeros(width, np.uint64)
        for j in range(overlap):
            window = window * _STEP + value[j : j + width]
        at = np.flatnonzero(mix(window) % np.uint64(spacing) == 0)
        starts = np.union1d(first, at[text[at] == text[at + overlap - 1]])
    own = np.diff(starts, append=len(words))
    last = np.append(text[starts[1:]] != text[starts[:-1]], True)
    begin, stop = words.starts[starts], words.stops[starts + own - 1 + np.where(last, 0, overlap)]
    return text[starts], [data[i:j] for i, j in zip(begin.tolist(), stop.tolist(), strict=True)], last, own


def parse(docs: DataFrame, *, text_col: str, lang_col: str, overlap: int, spacing: int) -> DataFrame:
    """The dictionary: lang, chunk, last, words (its own) and copies."""

    def run(batches) -> Iterator[dict[str, list]]:
        langs, texts, size = [], [], 0

        def take() -> dict[str, list]:
            number, chunk, last, own = chunks_of(texts, overlap, spacing)
            return {
                "lang": pa.array(langs, pa.string()).take(pa.array(number, pa.int64())),
                "chunk": chunk,
                "last": pa.array(last),
                "words": pa.array(own, pa.int64()),
            }

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in _slices(plain(text)):
                    langs.append(lang)
                    texts.append(part)
                    size += len(part)
                    if size >= SLICE:
                        yield take()
                        langs, texts, size = [], [], 0
        if texts:
            yield take()

    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN))
    parsed = map_batches(docs.select(lang.alias("lang"), text_or_empty(text_col).alias("text")), run, _CHUNKS)
    return parsed.groupBy("lang", "chunk", "last").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("copies"))


def lang_hash(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def _bit(hashes: np.ndarray, size: int) -> np.ndarray:
    return mix(hashes) & np.uint64(size - 1)


class Bits:
    """Which runs of ``order`` words may be frequent, and which ``shorter`` ones, if that is known apart."""

    def __init__(self, order: int, table: np.ndarray, shorter: Bits | None = None):
        self.order, self.table, self.shorter = order, table, shorter

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bit = _bit(hashes, 64 * len(self.table))
        return (self.table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def run_hashes(hashes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the run that begins at each place, from the hashes of words."""
    width = max(0, len(hashes) - order + 1)
    value = np.zeros(width, np.uint64)
    for j in range(order):
        value = value * _STEP + hashes[j : j + width]
    return value


class Held:
    """Chunks side by side: their words, with hashes that tell languages apart."""

    def __init__(self, langs: pa.Array, chunks: pa.Array):
        _, offsets, data = chunks.buffers()
        ends = np.frombuffer(offsets, "<i4")[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        self.bytes = data.to_pybytes()[ends[0] : ends[-1]] if data is not None else b""
        ends = ends - ends[0]
        self.words = Words(np.frombuffer(self.bytes, np.uint8), ends[1:-1])
        self.chunk = np.searchsorted(ends[1:], self.words.starts, "right")
        numbers = langs.dictionary_encode()
        self.langs = numbers.dictionary.to_pylist()
        own = np.array([lang_hash(x) for x in self.langs], np.uint64)
        self.lang = numbers.indices.to_numpy(zero_copy_only=False)
        value, self.check = self.words.hashes()
        self.value = mix(value ^ own[self.lang[self.chunk]]) if len(value) else value


def own_places(held: Held, last: np.ndarray, low: int, overlap: int, bits: Bits | None) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks' own runs of ``low`` words or more begin, and for each word where runs from it must end."""
    words, chunk, size = held.words, held.chunk, len(held.words)
    places = np.arange(size)
    # Where the piece of each word ends, and the part of its chunk that is its own.
    apart = np.append(np.flatnonzero((words.piece[1:] != words.piece[:-1]) | (chunk[1:] != chunk[:-1])) + 1, size)
    reach = apart[np.searchsorted(apart, places, "right")]
    ends = np.searchsorted(chunk, np.arange(len(last)), "right")
    own = places < (ends - np.where(last, 0, overlap))[chunk]
    while bits:
        # Up to where runs may go on: the first shorter run that is not frequent.
        known = np.zeros(size, bool)
        hashes = run_hashes(held.value, bits.order)
        known[: len(hashes)] = bits.has(hashes)
        rare = np.append(np.flatnonzero(~known), size)
        reach = np.minimum(reach, rare[np.searchsorted(rare, places)] + bits.order - 1)
        bits = bits.shorter
    return np.flatnonzero(own & (reach - places >= low)), reach


def counted(
    held: Held, last: np.ndarray, copies: np.ndarray, low: int, high: int, overlap: int, bits: Bits | None
) -> Iterator[dict[str, list]]:
    """How often the chunks' own runs of ``low`` to ``high`` words occur, in parts."""
    words, chunk = held.words, held.chunk
    if not len(words):
        return
    at, reach = own_places(held, last, low, overlap, bits)
    often = copies[chunk]
    # Sums before each word, so that a run of any length is a difference.
    checks = np.append(np.uint64(0), np.cumsum(held.check))
    for n in range(low, high + 1):
        at = at[reach[at] - at >= n]
        if not len(at):
            return
        value = held.value[at]
        for j in range(1, n):
            value = value * _STEP + held.value[at + j]
        check = checks[at + n] - checks[at]
        order = np.argsort(value, kind="stable")
        ranked, marks = value[order], check[order]
        first = np.append(True, ranked[1:] != ranked[:-1])
        if (~first[1:] & (marks[1:] != marks[:-1])).any():
            # One hash for different runs: told apart by the second number.
            order = np.lexsort((check, value))
            ranked, marks = value[order], check[order]
            first = np.append(True, (ranked[1:] != ranked[:-1]) | (marks[1:] != marks[:-1]))
        first = np.flatnonzero(first)
        total, example = np.add.reduceat(often[at[order]], first), at[order[first]]
        names = pa.array(held.langs, pa.string())
        for k in range(0, len(example), ROWS_AT_ONCE):
            part = example[k : k + ROWS_AT_ONCE]
            begin, stop = words.starts[part].tolist(), words.stops[part + n - 1].tolist()
            yield {
                "lang": names.take(pa.array(held.lang[chunk[part]], pa.int64())),
                "phrase": [held.bytes[i:j] for i, j in zip(begin, stop, strict=True)],
                "words": pa.array(np.full(len(part), n, np.int32)),
                "n": pa.array(total[k : k + ROWS_AT_ONCE], pa.int64()),
            }


def _by_tables(batches: Iterator[pa.RecordBatch], function: Callable[[Held, np.ndarray, np.ndarray], Iterable]) -> Iterator:
    """What a function of chunks, whether a text ends with them, and their copies gives: for many chunks at a time."""

    def take() -> Iterable:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        lang, chunk, last, copies = (c.chunk(0) if c.num_chunks else c.combine_chunks() for c in rows.columns)
        return function(Held(lang, chunk), last.to_numpy(zero_copy_only=False), copies.to_numpy())

    waiting, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield from take()
            waiting, size = [], 0
    if waiting:
        yield from take()


def count_runs(chunks: DataFrame, low: int, high: int, overlap: int, bits: Bits | None, min_count: int) -> DataFrame:
    """lang, phrase, words and n of all runs of ``low`` to ``high`` words that occur ``min_count`` times or more."""
    shared = chunks.sparkSession.sparkContext.broadcast(bits)

    def run(batches) -> Iterator[dict[str, list]]:
        return _by_tables(batches, lambda held, last, copies: counted(held, last, copies, low, high, overlap, shared.value))

    found = map_batches(chunks.select("lang", "chunk", "last", "copies"), run, _COUNTS)
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def add_up(counts: list[np.ndarray], most: int) -> np.ndarray:
    """Counts in the lower halves of numbers, added up by the upper halves, which then ascend; sums end at ``most``."""
    ranked = np.concatenate(counts) if counts else np.zeros(0, np.uint64)
    if not len(ranked):
        return ranked
    ranked.sort()
    keys = (ranked >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ranked &= np.uint64(0xFFFFFFFF)
    total = np.minimum(np.add.reduceat(ranked, first), np.uint64(most))
    return keys[first].astype(np.uint64) << np.uint64(32) | total


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first: the upper ones are mostly alike and take no space once compressed."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.uint64)


def key_rows(counts: np.ndarray) -> dict[str, list]:
    """A row for each range of keys: the steps from one key to the next, and the counts."""
    keys, often = (counts >> np.uint64(32)).astype(np.uint32), counts.astype(np.uint32)
    ranges = keys >> np.uint32(RANGE_BITS)
    starts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])[: len(keys)])
    steps = np.diff(keys, prepend=np.uint32(0))
    steps[starts] = keys[starts] & np.uint32((1 << RANGE_BITS) - 1)
    borders = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)) if len(starts) else []
    return {
        "range": pa.array(ranges[starts].astype(np.int32), pa.int32()),
        "steps": [_planes(steps[i:j]) for i, j in borders],
        "counts": [_planes(often[i:j]) for i, j in borders],
    }


def key_counts(steps: bytes, counts: bytes) -> np.ndarray:
    """Keys within their range in the upper halves, counts in the lower ones."""
    return np.cumsum(_from_planes(steps)) << np.uint64(32) | _from_planes(counts)


def likely_bits(chunks: DataFrame, order: int, overlap: int, bits: Bits | None, min_count: int) -> Bits:
    """The bit table of all runs of ``order`` words that may occur ``min_count`` times or more."""
    shared = chunks.sparkSession.sparkContext.broadcast(bits)
    # Sums need not go on beyond what decides.
    most = max(1, min(min_count, (1 << 32) - 1))

    def keys_of(held: Held, last: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
        if not len(held.words):
            return []
        at, _ = own_places(held, last, order, overlap, shared.value)
        keys = _bit(run_hashes(held.value, order)[at], 1 << KEY_BITS)
        return [add_up([keys << np.uint64(32) | np.minimum(copies[held.chunk[at]], most).astype(np.uint64)], most)]

    def send(batches) -> Iterator[dict[str, list]]:
        waiting, size = [], 0
        for counts in _by_tables(batches, keys_of):
            waiting.append(counts)
            size += len(counts)
            if size >= KEYS_AT_ONCE:
                yield key_rows(add_up(waiting, most))
                waiting, size = [], 0
        yield key_rows(add_up(waiting, most))

    def receive(batches) -> Iterator[dict[str, list]]:
        waiting, size, current = [], 0, None

        def likely() -> dict[str, list]:
            found = add_up(waiting, most)
            found = found[found & np.uint64(0xFFFFFFFF) >= np.uint64(most)] >> np.uint64(32)
            return {"key": pa.array((found + np.uint64((current or 0) << RANGE_BITS)).astype(np.int64), pa.int64())}

        for batch in batches:
            for number, steps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != current:
                    yield likely()
                    waiting, size, current = [], 0, number
                waiting.append(key_counts(steps, counts))
                size += len(waiting[-1])
                # A range has at most 2 ** RANGE_BITS keys.
                if size >= max(KEYS_AT_ONCE, 2 * len(waiting[0])):
                    waiting = [add_up(waiting, most)]
                    size = len(waiting[0])
        yield likely()

    sent = map_batches(chunks.select("lang", "chunk", "last", "copies"), send, _KEYS)
    dealt = sent.repartition("range").sortWithinPartitions("range")
    keys = materialize(map_batches(dealt, receive, "key long"), f"keys-{order}")
    size = table_size(keys.count())
    bit = F.col("key").bitwiseAND(F.lit(size - 1))
    words = keys.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bits"))
    return bit_table(words, order, size, bits)


def table_size(runs: int) -> int:
    """Bits of the table of so many runs."""
    size = 1 << 16
    while size < MAX_BITS and size < BITS_PER_RUN * runs:
        size *= 2
    return size


def bit_table(words: DataFrame, order: int, size: int, shorter: Bits | None = None) -> Bits:
    """The table of ``size`` bits from words of 64 bits, ``bits``, and their places, ``at``."""
    # At most a row for each 64 bits of a table of bounded size.
    found = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bits(order, table, shorter)


def mine(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    spacing: int = SPACING,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n and score."""
    prepare(docs.sparkSession)
    overlap = max_words - 1
    chunks = materialize(parse(docs, text_col=text_col, lang_col=lang_col, overlap=overlap, spacing=spacing), "chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("words") * F.col("copies")).alias("total"))
    bits = None
    for order in range(1, min(KEYED_WORDS, max_words) + 1):
        bits = likely_bits(chunks, order, overlap, bits, min_count)
    frequent = materialize(count_runs(chunks, 1, max_words, overlap, bits, min_count), "runs")
    return rank_phrases(frequent, totals, top)


def rank_phrases(frequent: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Score candidates at their weakest cut, and drop those that longer ones cover."""
    runs = frequent.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "n")
    candidates = runs.filter(F.col("words") > 1).withColumnRenamed("n", "a")
    parts = F.split("phrase", " ")

    def joined(first, n):
        return F.array_join(F.slice(parts, first, n), " ")

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = lambda side, name: runs.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    wide = lambda name: f"cast({name} as decimal(38,0))"
    scored = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(F.broadcast(totals), "lang")
    score = F.expr(f"(cast(1000 as decimal(38,0)) * {wide('a')} * {wide('total')}) div ({wide('l')} * {wide('r')})")
    weakest = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.max("a").alias("a"), F.max("total").alias("n")
    )
    # All runs of two words or more within longer candidates.
    longer = candidates.filter(F.col("words") > 2).select("lang", "a", "phrase", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    longer = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("from"))
    around = longer.select("lang", joined(F.col("from"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = weakest.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (F.col("around") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
