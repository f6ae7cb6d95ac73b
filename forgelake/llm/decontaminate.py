"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment (operator 3).

Every test item whose best local alignment with a document reaches the least score is found. The score is the
alignment's share of the item's own score: 1 for a whole copy, less with edits.

1. **Seeds.** A seed is a pair of words, next to each other or with one word between them. An alignment of m
   matches and e errors scores 2 m - e, so where that reaches the share s of an item's n words, m - 1 - e / 2 is at
   least s n - 1: of the steps from one match to the next, so many have one error at most, and such a
   step is a pair of the item that the document has too, also in one of the two distances. Its first words
   are different words of the item. So of the n - 1 words that can begin a pair, all but s n - 2 are enough to be
   seeds: an alignment that reaches the score has one of them.
2. **Rarity.** A pass over all documents counts in how many each pair of the items occurs. The words whose pairs
   occur in the fewest documents are chosen; pairs that occur nowhere cost nothing.
3. **Join.** A second pass joins documents to the items of the seeds they hold. What it costs follows the
   seeds found, not the number of items.
4. **Alignment.** A joined item is aligned with the places that two bounds leave, neither of which can rule out an
   alignment that reaches the score. So many of the document's words within the longest passage such an
   alignment can cover are words of the item; passages that overlap are one place. Matches for all words of
   the item in some part of the document, less a step for each word in between, make up the score; and so do
   the place's words when none counts more often than the item has it.

Items are few beside documents: they are broadcast in blocks of at most ``BLOCK_WORDS`` words on average,
and each block is held against all documents, so nothing about a document is shuffled and a passage in a
third of all documents is no hot key.

Defined results: documents and items with a NULL or empty text match nothing. Items of fewer than
``WHOLE_WORDS`` words match only as a whole, all their words in a row. Items with the same text all match.
Rows that repeat are judged one by one. Of several places in one document the best counts, the first on a
tie. An empty benchmark or table gives no matches. Other columns pass through; if one is called ``_matches``, the
matches take the next free name (``free_name``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgelake.llm.common import free_name, map_batches, prepare, text_or_empty, type_of
from forgelake.llm.words import WORD, mix, texts_hashes, word_hashes

# Items of fewer words match only as a whole.
WHOLE_WORDS = 3
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
# Words of test items that are broadcast at once.
BLOCK_WORDS = 1 << 20
MATCHES = "_matches"
_BITS = 20
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _pairs(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word with the next one, and with the one after that."""
    return [mix(words[: max(0, len(words) - d)] * _PAIR + words[d:]) for d in (1, 2)]


@dataclass
class Seeds:
    """Sorted hashes of seeds, and for each the items it is of, between two offsets."""

    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    marks: np.ndarray
    # Whether single words are seeds: those of items of one word.
    words: bool

    @staticmethod
    def of(hashes: list[np.ndarray], words: bool) -> Seeds:
        """``hashes`` has an array per item."""
        value = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        distinct, number = np.unique(value, return_inverse=True)
        order = np.argsort(number, kind="stable")
        bits = min(26, max(16, (32 * len(distinct)).bit_length()))
        marks = np.zeros(1 << bits, bool)
        marks[distinct >> np.uint64(64 - bits)] = True
        return Seeds(distinct, np.searchsorted(number[order], np.arange(len(distinct) + 1)), item[order], marks, words)

    def hits(self, words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of text and seed; ``texts`` numbers the text of each word."""
        shift = np.uint64(64 - (len(self.marks).bit_length() - 1))
        found = []
        for d, hashes in enumerate([mix(words ^ _PAIR) if self.words else words[:0], *_pairs(words)]):
            at = np.flatnonzero(self.marks[hashes >> shift])
            at = at[texts[at] == texts[at + d]]
            number = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            same = self.hashes[number] == hashes[at] if len(self.hashes) else np.zeros(0, bool)
            found.append(texts[at][same] * len(self.hashes) + number[same])
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.hashes)))

    def joined(self, words: np.ndarray, texts: np.ndarray) -> list[tuple[int, int]]:
        """Distinct pairs of text and item that share a seed, ascending."""
        text, seed = self.hits(words, texts)
        length = self.first[seed + 1] - self.first[seed]
        rows = np.repeat(self.first[seed] - np.append(0, np.cumsum(length)[:-1])[: len(length)], length) + np.arange(length.sum())
        pairs = np.unique(np.repeat(text, length) << 32 | self.item[rows])
        return list(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True))


@dataclass
class Items:
    """Test items, and their words."""

    ids: list
    words: list[np.ndarray]
    # Sorted distinct words; per item the numbers of its words there and how often it has each.
    vocabulary: np.ndarray
    numbers: list[np.ndarray]
    counts: list[np.ndarray]
    marks: np.ndarray
    seeds: Seeds

    @staticmethod
    def of(rows: list[tuple], min_score: float = MIN_SCORE) -> Items:
        ids, words = [], []
        for key, text in rows:
            found = word_hashes(text or "")
            if len(found):
                ids.append(key)
                words.append(found)
        vocabulary = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
        distinct = [np.unique(w, return_counts=True) for w in words]
        numbers, counts = [np.searchsorted(vocabulary, w) for w, _ in distinct], [n for _, n in distinct]
        marks = np.zeros(1 << _BITS, bool)
        marks[vocabulary >> np.uint64(64 - _BITS)] = True
        items = Items(ids, words, vocabulary, numbers, counts, marks, Seeds.of([], False))
        return items.with_seeds(min_score)

    def _beginnings(self, words: np.ndarray) -> np.ndarray:
        """A row for each word of an item that begins pairs: their hashes, twice where there is one."""
        if len(words) == 1:
            return mix(words ^ _PAIR)[:, None].repeat(2, 1)
        one, two = _pairs(words)
        return np.stack([one, np.append(two, one[-1:])], 1)

    def all_pairs(self) -> Seeds:
        """As if every pair were a seed."""
        return Seeds.of([np.unique(self._beginnings(w)) for w in self.words], any(len(w) == 1 for w in self.words))

    def with_seeds(self, min_score: float, seen: tuple[np.ndarray, np.ndarray] | None = None) -> Items:
        """With the seeds that are enough for the score, the rarest. ``seen`` has the pairs that occur in documents, ascending,
        and in how many; without it all are taken to be as frequent."""
        chosen = []
        for words in self.words:
            pairs = self._beginnings(words)
            least = min_score if len(words) >= WHOLE_WORDS else 1.0
            spared = max(0, int(np.ceil(least * len(words) - 1 - 1e-9)) - 1)
            if seen is None:
                chosen.append(np.unique(pairs[: len(pairs) - spared]))
                continue
            hashes, often = seen
            at = np.minimum(np.searchsorted(hashes, pairs), max(0, len(hashes) - 1))
            n = np.where(hashes[at] == pairs, often[at], 0) if len(hashes) else np.zeros(pairs.shape, np.int64)
            rarest = np.argsort(n.sum(1), kind="stable")[: len(pairs) - spared]
            chosen.append(np.unique(pairs[rarest][n[rarest] > 0]))
        return replace(self, seeds=Seeds.of(chosen, any(len(w) == 1 for w in self.words)))

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the items' words in a text, and their numbers."""
        at = np.flatnonzero(self.marks[words >> np.uint64(64 - _BITS)])
        number = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[number] == words[at]
        return at[same], number[same]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score, and start and end of its part of the window."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        slope = GAP * np.arange(len(b) + 1)
        row, top, end = np.zeros(len(b) + 1, np.int64), 0, 0
        for word in a:
            step = np.where(b == word, MATCH, MISMATCH) + row[:-1]
            new = np.maximum(np.append(0, step), row + GAP)
            np.maximum(new, 0, out=new)
            # Gaps along the row: the best cell to the left less the steps from there.
            row = np.maximum.accumulate(new - slope) + slope
            at = int(row.argmax())
            if row[at] > top:
                top, end = int(row[at]), at
        return top, end

    score, end = best(item, window)
    if not score:
        return 0, 0, 0
    _, length = best(item[::-1], window[:end][::-1])
    return score, end - length, end


def _places(at: np.ndarray, need: int, width: int) -> Iterator[tuple[int, int]]:
    """Ranges of the ascending positions ``at`` that hold all passages of ``width`` words with ``need`` of them."""
    starts = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < width) if len(at) >= need else np.zeros(0, np.int64)
    if not len(starts):
        return
    apart = np.flatnonzero(at[starts[1:]] - at[starts[:-1] + need - 1] >= width) + 1
    for part in np.split(starts, apart):
        yield int(part[0]), int(part[-1]) + need


def matches(words: np.ndarray, items: Items, min_score: float) -> list[tuple[int, float, int, int]]:
    """Items found in a text: number, score, start and end in words."""
    return _aligned(words, items, [k for _, k in items.seeds.joined(words, np.zeros(len(words), np.int64))], min_score)


def _aligned(words: np.ndarray, items: Items, keys: list[int], min_score: float) -> list[tuple[int, float, int, int]]:
    """As ``matches``, of the items that the text was joined to."""
    found = []
    at, number = items.lookup(words)
    for key in keys:
        target, length = items.words[key], len(items.words[key])
        least = min_score if length >= WHOLE_WORDS else 1.0
        need = max(1, int(np.ceil(least * length - 1e-9)))
        # Every word between the matches costs a step, and only so many leave the score.
        width = length + int(MATCH * length * (1 - least) / -max(MISMATCH, GAP) + 1e-9)
        where = np.minimum(np.searchsorted(items.numbers[key], number), len(items.numbers[key]) - 1)
        own = items.numbers[key][where] == number
        hits, where = at[own], where[own]
        # A match for each of the item's words from one to another, less the steps in between.
        slope = (MATCH + 1) * np.arange(len(hits)) - hits
        if (slope - np.minimum.accumulate(slope)).max(initial=0) + MATCH < least * MATCH * length - 1e-9:
            continue
        best = (0.0, 0, 0)
        for a, b in _places(hits, need, width):
            place = hits[a:b]
            if np.minimum(np.bincount(where[a:b], minlength=len(items.counts[key])), items.counts[key]).sum() < need:
                continue
            low = int(place[0])
            score, start, end = align(target, words[low : int(place[-1]) + 1])
            share = score / (MATCH * length)
            if share >= least and share > best[0]:
                best = (share, low + start, low + end)
        if best[0]:
            found.append((key, *best))
    return found


def _spans(text: str, found: list[tuple[int, float, int, int]]) -> list[tuple[int, int]]:
    """Character offsets of word ranges."""
    borders = [m.span() for m in WORD.finditer(text.lower())]
    return [(borders[start][0], borders[end - 1][1]) for _, _, start, end in found]


def _joined(texts: list[str], seeds: Seeds) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """The texts that share a seed with an item: number, words, and the items."""
    before = 0
    for words, counts in texts_hashes(texts):
        ends = np.cumsum(counts)
        pairs = seeds.joined(words, np.repeat(np.arange(len(counts)), counts))
        for text, group in groupby(pairs, key=lambda p: p[0]):
            yield before + text, words[ends[text] - counts[text] : ends[text]], [item for _, item in group]
        before += len(counts)


def _document_counts(texts: DataFrame, pairs: Seeds) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that occur in documents, ascending, and in how many."""
    shared = texts.sparkSession.sparkContext.broadcast(pairs)

    def count(batches) -> Iterator[dict[str, list]]:
        held = shared.value
        total = np.zeros(len(held.hashes), np.int64)
        for batch in batches:
            for words, counts in texts_hashes(batch.column(0).to_pylist()):
                _, seed = held.hits(words, np.repeat(np.arange(len(counts)), counts))
                total += np.bincount(seed, minlength=len(total))
        at = np.flatnonzero(total)
        yield {"seed": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())}

    counted = map_batches(texts, count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    # At most a row for each pair of a block of items.
    found = counted.orderBy("seed").toArrow()
    return pairs.hashes[found["seed"].to_numpy()], found["n"].to_numpy()


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    min_score: float = MIN_SCORE,
    block_words: int = BLOCK_WORDS,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs`` with ``_matches``: an array of item_id, score, start_word,
    n_words and passage, one entry per test item found, ordered as the items were read."""
    if min_score * WHOLE_WORDS <= 1:
        raise ValueError(f"min_score must be above 1 / {WHOLE_WORDS}: below, a single word would do")
    spark = prepare(docs.sparkSession)
    items = benchmark.select(F.col(item_id).alias("id"), text_or_empty(item_text).alias("text"))
    key = type_of(items, "id")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    match = T.StructType(
        [
            T.StructField("item_id", key),
            T.StructField("score", T.DoubleType()),
            T.StructField("start_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("passage", T.StringType()),
        ]
    )
    names, column = docs.columns, free_name(MATCHES, docs.columns)
    own_text = free_name("_text", [*names, column])
    out = docs.withColumn(column, F.array().cast(T.ArrayType(match)))
    for number in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == number)
        block = Items.of([(r["id"], r["text"]) for r in mine.orderBy("id", "text").collect()], min_score)
        seen = _document_counts(docs.select(text_or_empty(text_col)), block.all_pairs()) if block.ids else None
        if seen is None or not len(seen[0]):
            continue
        shared = spark.sparkContext.broadcast(block.with_seeds(min_score, seen))

        def run(batches, shared=shared) -> Iterator[dict[str, list]]:
            held = shared.value
            for batch in batches:
                *kept, before, texts = batch.columns
                texts = texts.to_pylist()
                found_in = before.to_pylist()
                for text_number, words, keys in _joined(texts, held.seeds):
                    found = _aligned(words, held, keys, min_score)
                    spans = _spans(texts[text_number], found) if found else []
                    found_in[text_number] = found_in[text_number] + [
                        {"item_id": held.ids[k], "score": s, "start_word": a, "n_words": b - a, "passage": texts[text_number][x:y]}
                        for (k, s, a, b), (x, y) in zip(found, spans, strict=True)
                    ]
                yield {**dict(zip(names, kept, strict=True)), column: found_in}

        out = map_batches(out.withColumn(own_text, text_or_empty(text_col)), run, out.schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no test item was found."""
    column = free_name(MATCHES, docs.columns)
    return find(docs, benchmark, **options).filter(F.size(F.col(column)) == 0).drop(column)
