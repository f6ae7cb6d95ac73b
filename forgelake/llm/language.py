"""Language identification with language-bitmask n-gram filters (operator 7).

Training finds, for every character n-gram of lower-case words, the languages it is typical of: those
where its rate is at least ``MIN_SHARE`` of its highest rate in any language. The filter is a Bloom
filter in bit slices: a row per position, a bit per language. An n-gram is entered into its languages'
bits of the rows its hashes name; the AND of these rows gives all languages that contain it at once.

Prediction looks up the distinct-by-position n-grams of a text, counts the bits of each language
(popcount), and corrects each count for false positives: with ``n`` n-grams, ``h`` hits and a false
positive rate ``p`` of the language's slice, ``(h - n p) / (1 - p)``. The highest corrected count
decides, ties go to the language that sorts first. The score is its share of the two highest counts.

Training reads all rows. So that the filter, which has ``ROWS`` rows whatever the corpus, does not fill with ever
rarer n-grams, an n-gram must occur in ``MIN_COUNT`` texts of ``COUNTED`` of each language: of larger languages
all texts are counted, and the count is scaled. ``max_rows`` limits the rows read of each language, chosen by a
hash of the text.

Defined results: a NULL text, or one without a letter, is ``und`` with score 0, as is every text if
nothing was learned. If no n-gram is known, the first language wins with score 0. NULL languages are not
learned from. Repeated rows count once each in training. A long text is taken in slices and is never cut
short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgelake.llm.common import free_name, map_batches, prepare
from forgelake.session import materialize

UNKNOWN = "und"
SIZES = (1, 2, 3, 4, 5)
# An n-gram belongs to a language if its rate there is this share of its highest rate.
MIN_SHARE = 0.1
# Texts an n-gram must occur this often in, over all languages, where none has more texts than COUNTED.
MIN_COUNT = 3
COUNTED = 10_000
# Scaled counts are whole numbers of this part, so that their sums are exact in any order.
_PARTS = 1_000_000
# Rows of the bit-sliced filter (a power of two), and rows per n-gram.
ROWS = 1 << 21
HASHES = 3
# Standard deviations above the false positives from which n-grams count as covered.
NOISE = 6
# Characters looked up at a time.
_SLICE = 1 << 20
_WORD = 63
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def ngram_hashes(text: str, sizes=SIZES) -> np.ndarray:
    """A 64-bit hash for every n-gram at every position of the text's words, borders marked by a space."""
    clean = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    points = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    inner = points != 32
    if not inner.any():
        return np.zeros(0, np.uint64)
    out = []
    value, good = np.zeros(len(points), np.uint64), np.ones(len(points), bool)
    for n in range(1, max(sizes) + 1):
        width = len(points) - n + 1
        if width <= 0:
            break
        value = value[:width] * np.uint64(0x100000001B3) + points[n - 1 :]
        # No border inside, unless at either end.
        good = good[:width] if n <= 2 else good[:width] & inner[n - 2 : n - 2 + width]
        if n in sizes:
            keep = good if n > 1 else inner[:width]
            mixed = value[keep] + np.uint64(n)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            out.append(mixed ^ (mixed >> np.uint64(29)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def filter_rows(hashes: np.ndarray, rows: int, k: int = HASHES) -> list[np.ndarray]:
    """The rows of the filter that each hash names."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(rows - 1)).astype(np.int64) for i in range(k)]


@dataclass
class LanguageFilter:
    """``slices[w]`` holds the bits of languages ``63 w`` to ``63 w + 62`` for every row."""

    languages: list[str]
    slices: list[np.ndarray]
    false_rates: np.ndarray
    sizes: tuple[int, ...] = SIZES

    def hits(self, text: str) -> tuple[int, np.ndarray]:
        """How many n-grams the text has, and how many of them each language's slice contains."""
        found, total = np.zeros(len(self.languages), np.int64), 0
        for start in range(0, len(text), _SLICE):
            hashes = ngram_hashes(text[start : start + _SLICE], self.sizes)
            at = filter_rows(hashes, len(self.slices[0]))
            total += len(hashes)
            for w, bits in enumerate(self.slices):
                masks = bits[at[0]]
                for rows in at[1:]:
                    masks = masks & bits[rows]
                for b in range(min(_WORD, len(self.languages) - w * _WORD)):
                    found[w * _WORD + b] += np.count_nonzero(masks & masks.dtype.type(1 << b))
        return total, found

    def judge(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score, share of the n-grams that the language covers beyond its false positives, and their
        number. The share is 0 if it is within ``NOISE`` standard deviations of the false positives."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, 0
        total, found = self.hits(text)
        counts = np.maximum(0.0, (found - total * self.false_rates) / (1 - self.false_rates))
        best = int(np.argmax(counts))
        rest = np.delete(counts, best).max(initial=0.0)
        share = counts[best] / (counts[best] + rest) if counts[best] > 0 else 0.0
        p = self.false_rates[best]
        clear = counts[best] * (1 - p) > NOISE * np.sqrt(total * p * (1 - p))
        return self.languages[best], float(share), float(counts[best] / total) if clear else 0.0, total

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def train(
    labelled: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int | None = None,
    min_share: float = MIN_SHARE,
    min_count: int = MIN_COUNT,
    rows: int = ROWS,
    sizes: tuple[int, ...] = SIZES,
) -> LanguageFilter:
    """Learn the filter from the rows of ``labelled`` that have a text and a language."""
    prepare(labelled.sparkSession)
    known = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    # One row per language.
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageFilter([], [np.zeros(rows, np.int64)], np.zeros(0), sizes)
    if max_rows is not None and max_rows < max(totals.values()):
        share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, max_rows / totals[lang]))))
        known = known.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
        totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}

    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches) -> Iterator[dict[str, list]]:
        for batch in batches:
            per_language: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start in range(0, len(text), _SLICE):
                    per_language.setdefault(lang, []).append(np.unique(ngram_hashes(text[start : start + _SLICE], sizes)))
            for lang, parts in per_language.items():
                hashes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield {
                    "hash": pa.array(hashes.view(np.int64)),
                    "language": pa.array(np.full(len(hashes), number[lang], np.int32)),
                    "n": pa.array(n.astype(np.int64)),
                }

    counted = map_batches(known, count, "hash bigint, language int, n bigint")
    counts = counted.groupBy("hash", "language").agg(F.sum("n").alias("n"))
    read = {lang: max(1, totals.get(lang, 1)) for lang in languages}
    rates = F.create_map(*(F.lit(x) for lang in languages for x in (number[lang], 1.0 / read[lang])))
    weights = F.create_map(*(F.lit(x) for lang in languages for x in (number[lang], min(1.0, COUNTED / read[lang]))))
    scaled = F.floor(F.col("n") * weights[F.col("language")] * _PARTS)
    rated = counts.select("hash", "language", scaled.alias("n"), (F.col("n") * rates[F.col("language")]).alias("rate"))
    typical = rated.groupBy("hash").agg(
        F.sum("n").alias("n"), F.max("rate").alias("top"), F.collect_list(F.struct("language", "rate")).alias("by")
    )
    entered = (
        typical.filter(F.col("n") >= min_count * _PARTS)
        .select("hash", "top", F.explode("by").alias("b"))
        .filter(F.col("b.rate") >= min_share * F.col("top"))
        .select("hash", F.col("b.language").alias("language"))
    )

    def place(batches) -> Iterator[dict[str, list]]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            language = batch.column(1).to_numpy()
            for at in filter_rows(hashes, rows):
                yield {
                    "row": pa.array(at),
                    "word": pa.array(language // _WORD, pa.int32()),
                    "mask": pa.array(np.int64(1) << (language % _WORD).astype(np.int64)),
                }

    placed = map_batches(entered, place, "row bigint, word int, mask bigint")
    masks = placed.groupBy("row", "word").agg(F.bit_or("mask").alias("mask"))
    # At most ROWS rows for every 63 languages.
    found = materialize(masks, "language-filter").toArrow()
    kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.int64, 63)) if len(languages) <= bits or bits == 63)
    slices = [np.zeros(rows, kind) for _ in range(-(-len(languages) // _WORD))]
    at, word, mask = (found[c].to_numpy() for c in ("row", "word", "mask"))
    for w, bits in enumerate(slices):
        bits[at[word == w]] = mask[word == w].astype(kind)
    fill = [np.count_nonzero(slices[i // _WORD] & kind(1 << (i % _WORD))) / rows for i in range(len(languages))]
    return LanguageFilter(languages, slices, np.array(fill) ** HASHES, sizes)


def predict(
    docs: DataFrame,
    model: LanguageFilter,
    keep: list[Column | str],
    text_col: str = "text",
    names: tuple[str, ...] = ("lang_pred", "score"),
) -> DataFrame:
    """The columns ``keep`` of each row, the language and its score, called ``names``, with two more names also
    the covered share and the number of n-grams; of the row itself nothing but the text is read."""
    spark = prepare(docs.sparkSession)
    given = docs.select(*keep).schema
    text = free_name("_text", given.names)
    kept = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    shared = spark.sparkContext.broadcast(model)

    def run(batches) -> Iterator[dict[str, list]]:
        for batch in batches:
            found = [shared.value.judge(t) for t in batch.column(len(given.names)).to_pylist()]
            yield {
                **{n: batch.column(i) for i, n in enumerate(given.names)},
                **{n: [x[i] for x in found] for i, n in enumerate(names)},
            }

    schema = T.StructType(list(given.fields))
    for name, kind in zip(names, ("string", "double", "double", "long"), strict=False):
        schema = schema.add(name, kind)
    return map_batches(kept, run, schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL ids count as the text ``null``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % folds
