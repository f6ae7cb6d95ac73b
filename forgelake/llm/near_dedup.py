"""Near-duplicate documents by weighted minimum hashing of TF-IDF shingles (operator 2).

1. Two passes count document frequencies of word shingles. Only shingles in more than ``COMMON`` of all
   documents differ in their weight: the first pass counts by cells that shingles share, the second counts the
   shingles of well-filled cells one by one, so their numbers are exact. At most (mean shingles per document)
   / ``COMMON`` shingles are common, whatever the corpus; that table is broadcast.
2. A shingle weighs (1 + ln tf) times its idf, which falls from 1 + ``IDF_RANGE`` for rare shingles to 1
   for those in every document. The range is narrow so that a large group of near copies, whose own
   shingles are common, is not pulled apart by its rare edits.
3. Improved consistent weighted sampling draws ``BANDS * BAND_ROWS`` shingles per document, with
   probability equal to the weighted Jaccard similarity that two documents draw the same one. The
   draws of a band together name a bucket.
4. Texts that are equal word by word are one vertex. Vertices that share a bucket are compared: weighted
   Jaccard similarity of their full shingle sets, computed from the texts, of at least
   ``MIN_SIMILARITY``. The first round compares each vertex with its bucket's leader, which is the same
   vertex in most buckets of a group of copies. The next round looks at buckets that still hold several
   classes: up to ``SMALL`` vertices are compared pair by pair, of more each with the two that follow it in
   a random block of about ``BLOCK``, which joins most of what belongs together. The vertices of larger
   buckets that then still hold several classes go through an exact prefix join: a vertex is filed under
   those of its shingles, rarest first, of which one must be shared by any text at least
   ``MIN_SIMILARITY`` alike. All pairs of different classes filed under one shingle are compared, unless
   their sizes and the places of that shingle rule the similarity out. So each two vertices that share a
   bucket are compared, are ruled out by a bound, or are of one class already; no bucket is capped.
5. Classes are the connected components of the links; links not met directly are found through them.

Defined results: documents without a word (NULL and empty texts too) are classes of their own. Texts of
fewer than ``SHINGLE`` words have one shingle. A class is named by its least doc_id; NULL ids come last.
One document of a class is kept, the least by doc_id, then by a hash of the text; of rows equal in both,
one. An empty table gives an empty result. Texts are used whole, long ones in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgelake.llm.common import free_name, map_batches, prepare, text_or_empty, type_of
from forgelake.llm.components import components
from forgelake.llm.words import each_text, shingle_hashes
from forgelake.session import materialize

SHINGLE = 5
MIN_SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 4
COMMON = 0.01
IDF_RANGE = 0.25
SMALL, BLOCK = 8, 32
# Counters for shingles of vertices in crowded buckets; shingles that share one only cost time.
COUNTERS = 1 << 21
# Cells in which shingles are counted together first: a rare one then costs a task nothing but its cell.
CELLS = 1 << 18
# Shingles a task gathers before it adds them to its counts, and counts it holds before it gives them on.
FOLD = 1 << 18
_TABLE = 1 << 11
_PIECE = 512


def _gamma_quantiles(size: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of ``size`` equal steps, by Newton's method."""
    want = (np.arange(size) + 0.5) / size
    x = np.sqrt(2 * want) + want
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - want) / np.maximum(x * np.exp(-x), 1e-12), 1e-9)
    return x


_R = _gamma_quantiles(_TABLE).astype(np.float32)
_INVERSE_R = (1 / _R).astype(np.float32)
_LN_C = np.log(_gamma_quantiles(_TABLE)).astype(np.float32)
_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32) | np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32)


def draw(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Improved consistent weighted sampling: one hash of (shingle, level) per draw.

    Each shingle has, per draw, r and c from Gamma(2, 1) and b uniform, all taken from a hash of the
    shingle. With t = floor(ln w / r + b), the shingle with the least ln c - r (t - b + 1) is drawn.
    """
    draws = len(_ODD)
    best, drawn = np.full(draws, np.inf, np.float32), np.zeros(draws, np.uint64)
    narrow = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    ln_w = np.log(weights).astype(np.float32)
    rows = np.arange(draws)
    for start in range(0, len(shingles), _PIECE):
        h = (narrow[start : start + _PIECE] + _SHIFT) * _ODD
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        at = (h >> np.uint32(21)).astype(np.intp)
        r, inverse = _R.take(at), _INVERSE_R.take(at)
        ln_c = _LN_C.take((h >> np.uint32(10) & np.uint32(_TABLE - 1)).astype(np.intp))
        b = (h & np.uint32(1023)).astype(np.float32)
        b *= np.float32(1 / 1024)
        inverse *= ln_w[start : start + _PIECE]
        inverse += b
        t = np.floor(inverse, out=inverse)
        b -= t
        b -= np.float32(1)
        b *= r
        b += ln_c
        k = b.argmin(1)
        least = b[rows, k]
        better = least < best
        best[better] = least[better]
        level = t[rows, k].astype(np.int64).view(np.uint64)
        value = shingles[start + k] + level * np.uint64(0x9E3779B97F4A7C15)
        drawn[better] = value[better]
    return drawn


def band_hashes(drawn: np.ndarray) -> np.ndarray:
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in drawn.reshape(BANDS, BAND_ROWS).T:
        value = (value ^ column) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


class Weights:
    """Weights of the shingles of a text; ``common`` maps common shingles to their idf."""

    def __init__(self, shingles: np.ndarray, idf: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.idf = shingles[order], idf[order].astype(np.float32)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.shingles >> np.uint64(44)] = True

    @staticmethod
    def of(frequency: list[tuple[int, int]], documents: int, common: float, idf_range: float) -> Weights:
        shingles = np.array([h % (1 << 64) for h, _ in frequency], np.uint64)
        share = np.minimum(1.0, np.array([n for _, n in frequency], float) / max(1, documents))
        return Weights(shingles, 1 + idf_range * np.log(1 / share) / np.log(1 / common))

    def __call__(self, words: np.ndarray, size: int, idf_range: float) -> tuple[np.ndarray, np.ndarray]:
        shingles, tf = np.unique(shingle_hashes(words, size), return_counts=True)
        weights = np.full(len(shingles), 1 + idf_range, np.float32)
        at = np.flatnonzero(self.marks[shingles >> np.uint64(44)])
        if len(at) and len(self.shingles):
            number = np.minimum(np.searchsorted(self.shingles, shingles[at]), len(self.shingles) - 1)
            same = self.shingles[number] == shingles[at]
            weights[at[same]] = self.idf[number[same]]
        return shingles, weights * (1 + np.log(tf, dtype=np.float32))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least weights over sum of greatest, of two sorted shingle sets."""
    total = float(a[1].sum(dtype=float) + b[1].sum(dtype=float))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=float))
    return shared / (total - shared) if total > shared else 1.0


def narrow(shingles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles by the upper half of their hash, ascending, for comparing two texts; equal ones are added up."""
    values, inverse = np.unique((shingles >> np.uint64(32)).astype(np.uint32), return_inverse=True)
    return values, np.bincount(inverse, weights, len(values)).astype(np.float32)


class _Counts:
    """How often each value of a stream has come."""

    def __init__(self):
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        new, often = np.unique(values, return_counts=True)
        both, counts = np.concatenate([self.values, new]), np.concatenate([self.counts, often])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], counts[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        self.values, self.counts = both[first], np.add.reduceat(counts, first) if len(first) else counts


def _distinct_shingles(batches, size: int) -> Iterator[np.ndarray]:
    """The shingles of each row, each once."""
    for batch in batches:
        for words in each_text(batch.column(0).to_pylist()):
            yield np.unique(shingle_hashes(words, size))


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CELLS - 1)).astype(np.intp)


def _full_cells(texts: DataFrame, size: int, common: float) -> tuple[np.ndarray, int]:
    """For each cell whether its shingles together are counted in more than ``common`` of all rows; and how many rows."""

    def fill(batches) -> Iterator[dict[str, pa.Array]]:
        n, total, parts, waiting = 0, np.zeros(CELLS, np.int64), [], 0
        for shingles in _distinct_shingles(batches, size):
            n += 1
            parts.append(_cell(shingles))
            waiting += len(shingles)
            if waiting > FOLD:
                total += np.bincount(np.concatenate(parts), minlength=CELLS)
                parts, waiting = [], 0
        if parts:
            total += np.bincount(np.concatenate(parts), minlength=CELLS)
        at = np.flatnonzero(total)
        yield {"cell": pa.array(at.astype(np.int32)), "n": pa.array(total[at])}
        # The rows themselves have a number that no cell has.
        yield {"cell": pa.array([-1], pa.int32()), "n": pa.array([n], pa.int64())}

    filled = map_batches(texts, fill, "cell int, n bigint")
    counts = materialize(filled.groupBy("cell").agg(F.sum("n").alias("n")), "shingle-cells")
    rows = counts.filter("cell < 0").agg(F.sum("n")).first()[0] or 0
    found = counts.filter((F.col("cell") >= 0) & (F.col("n") > common * rows)).select("cell").toArrow()
    full = np.zeros(CELLS, bool)
    full[found["cell"].to_numpy()] = True
    return full, rows


def common_shingles(texts: DataFrame, size: int, common: float) -> DataFrame:
    """Shingles in more than ``common`` of all rows, with the number of rows each is in, however the rows are dealt
    out; a last row has the number of all rows.

    A shingle is in no more rows than its cell counts, so those of other than full cells are not common. The rest is
    counted by itself, in bounded memory: a task that has met many gives on their counts and starts anew.
    """
    full, documents = _full_cells(texts, size, common)
    spark = texts.sparkSession
    total = spark.range(1).select(F.lit(0).cast("bigint").alias("hash"), F.lit(0).cast("bigint").alias("n"), F.lit(documents).cast("bigint").alias("rows"))
    if not full.any():
        return total
    shared = spark.sparkContext.broadcast(full)

    def count(batches) -> Iterator[dict[str, pa.Array]]:
        held, parts, waiting = _Counts(), [], 0

        def given() -> dict[str, pa.Array]:
            return {"hash": pa.array(held.values.view(np.int64)), "n": pa.array(held.counts)}

        for shingles in _distinct_shingles(batches, size):
            parts.append(shingles[shared.value[_cell(shingles)]])
            waiting += len(parts[-1])
            if waiting > FOLD:
                held.add(np.concatenate(parts))
                parts, waiting = [], 0
                if len(held.values) > FOLD:
                    yield given()
                    held = _Counts()
        if parts:
            held.add(np.concatenate(parts))
        yield given()

    counted = map_batches(texts, count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") > common * documents).withColumn("rows", F.lit(0).cast("bigint"))
    return materialize(found.unionByName(total), "shingle-counts")


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, common: float, idf_range: float):
    """One row per document: doc_id, text_hash, key (16 bytes, NULL without words) and bands; and the weights."""
    text = text_or_empty(text_col)
    counts = common_shingles(docs.select(text), size, common)
    documents = counts.agg(F.sum("rows")).first()[0] or 0
    frequent = counts.filter(F.col("n") > common * documents).select("hash", "n").collect()
    weights = Weights.of([(r["hash"], r["n"]) for r in frequent], documents, common, idf_range)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches) -> Iterator[dict[str, list]]:
        for batch in batches:
            keys, bands = [], []
            for words in each_text(batch.column(2).to_pylist()):
                keys.append(md5(words.tobytes()).digest() if len(words) else None)
                bands.append(band_hashes(draw(*shared.value(words, size, idf_range))) if len(words) else None)
            yield {"doc_id": batch.column(0), "text_hash": batch.column(1), "key": keys, "bands": bands}

    schema = T.StructType(
        [
            T.StructField("doc_id", type_of(docs, id_col)),
            T.StructField("text_hash", T.LongType()),
            T.StructField("key", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    return materialize(map_batches(docs.select(id_col, F.xxhash64(text), text), run, schema), "sketches"), shared


def _shingles_of(sources: DataFrame, keys: DataFrame, chosen: DataFrame, shared, size: int, idf_range: float) -> DataFrame:
    """key, shingles and weights (binary) of the vertices in ``chosen``, computed from one text each."""
    place = F.struct("doc_id", "text_hash")
    rows = keys.join(chosen, "key", "left_semi").groupBy("key").agg(F.min(place).alias("at"))
    named = materialize(rows.select("key", F.col("at.doc_id").alias("_id1"), F.col("at.text_hash").alias("_hash1")), "vertices")
    same = sources["_id0"].eqNullSafe(named["_id1"]) & (sources["_hash0"] == named["_hash1"])
    # A merge join at every size: whether the vertices happen to be few enough to broadcast shall not matter.
    texts = sources.join(named.hint("merge"), same).select("key", "_text")
    repeated = keys.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        # Rows equal in id and text stand for one vertex, so all but one of them go.
        texts = texts.dropDuplicates(["key"])

    def run(batches) -> Iterator[dict[str, list]]:
        for batch in batches:
            found = [narrow(*shared.value(words, size, idf_range)) for words in each_text(batch.column(1).to_pylist())]
            yield {
                "key": batch.column(0),
                "shingles": [s.tobytes() for s, _ in found],
                "weights": [w.tobytes() for _, w in found],
            }

    return map_batches(texts, run, "key binary, shingles binary, weights binary")


def _verified(pairs: DataFrame, payload: DataFrame, min_similarity: float) -> DataFrame:
    """The pairs (u, v) with their weighted Jaccard similarity."""
    side = lambda name: payload.select(F.col("key").alias(name), F.struct("shingles", "weights").alias(f"_{name}"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v")

    def run(batches) -> Iterator[dict[str, list]]:
        def read(x):
            return np.frombuffer(x["shingles"], np.uint32), np.frombuffer(x["weights"], np.float32)

        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            scores = [weighted_jaccard(read(x), read(y)) for x, y in zip(a, b, strict=True)]
            yield {"u": batch.column(0), "v": batch.column(1), "similarity": pa.array(scores, pa.float64())}

    found = map_batches(joined.select("u", "v", "_u", "_v"), run, "u binary, v binary, similarity double")
    return found.withColumn("linked", F.col("similarity") >= min_similarity)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _leader_pairs(buckets: DataFrame) -> DataFrame:
    """Each vertex with the leader of each of its buckets."""
    leaders = buckets.groupBy("bucket").agg(F.min_by("key", F.xxhash64("key")).alias("b"))
    return _ordered(buckets.join(leaders, "bucket").filter("key != b").select(F.col("key").alias("a"), "b"))


def _mixed(members: DataFrame) -> DataFrame:
    """The buckets that hold several classes, and how many vertices."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("class").alias("_low"), F.max("class").alias("_high"))
    return sizes.filter(F.col("_low") != F.col("_high")).select("bucket", "_n")


def _near_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of different classes within the buckets that hold several: all of up to ``SMALL`` vertices, some of more."""
    mixed = _mixed(members)
    blocks = F.when(F.col("_n") <= SMALL, F.lit(1)).otherwise(F.ceil(F.col("_n") / BLOCK))
    placed = members.join(mixed, "bucket").withColumn("_block", F.pmod(F.xxhash64("key", "bucket", F.lit(turn)), blocks))
    # A block holds about BLOCK vertices, at random.
    cell = F.struct(F.xxhash64("key", F.lit(turn)).alias("order"), "key", "class")
    cells = placed.groupBy("bucket", "_block", "_n").agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    reach = F.when(F.col("_n") <= SMALL, F.lit(SMALL)).otherwise(F.lit(2))
    pairs = F.flatten(
        F.transform(
            "_cells",
            lambda x, i: F.transform(
                F.filter(F.slice("_cells", i + 2, reach), lambda y: y["class"] != x["class"]),
                lambda y: F.struct(x["key"].alias("a"), y["key"].alias("b")),
            ),
        )
    )
    return _ordered(cells.select(F.explode(pairs).alias("p")).select("p.a", "p.b"))


def _shingle_counts(payload: DataFrame) -> np.ndarray:
    """Per counter, how many vertices have a shingle that it stands for; at least the shingle's own number."""

    def count(batches) -> Iterator[dict[str, pa.Array]]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for shingles in batch.column(0).to_pylist():
                total[np.frombuffer(shingles, np.uint32) & np.uint32(COUNTERS - 1)] += 1
        at = np.flatnonzero(total)
        yield {"at": pa.array(at.astype(np.int32)), "n": pa.array(total[at])}

    counted = map_batches(payload.select("shingles"), count, "at int, n bigint")
    found = counted.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(COUNTERS, np.int32)
    total[found["at"].to_numpy()] = np.minimum(found["n"].to_numpy(), np.iinfo(np.int32).max)
    return total


def _exact_pairs(members: DataFrame, payload: DataFrame, min_similarity: float) -> DataFrame | None:
    """All pairs of different classes that may be ``min_similarity`` alike, of the vertices in buckets of more than
    ``SMALL`` that hold several classes; None if there are no such buckets.

    In one order of all shingles, here by number of vertices, what two texts share weighs no more than the
    rest of either text from their first common shingle on, so at that shingle both rests reach the weight
    that two texts of their sizes must share. A vertex is filed under the shingles whose rest is large enough
    for any partner. Shingles of one vertex are left out by the counters, those of one class by a count; of
    the class most frequent at a shingle, no pairs are formed.
    """
    crowded = _mixed(members).filter(F.col("_n") > SMALL).select("bucket")
    chosen = materialize(members.join(crowded, "bucket", "left_semi").select("key", "class").distinct(), "crowded")
    if chosen.isEmpty():
        return None
    rows = payload.join(chosen, "key").select("shingles", "weights", "key", "class")
    shared = payload.sparkSession.sparkContext.broadcast(_shingle_counts(rows))
    # Rounding shall not rule out a pair.
    least = min_similarity * (1 - 1e-4)

    def file(batches) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            columns = [[], [], []]
            lengths = []
            for shingles, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingles, weights = np.frombuffer(shingles, np.uint32), np.frombuffer(weights, np.float32)
                counts = shared.value[shingles & np.uint32(COUNTERS - 1)]
                order = np.lexsort((shingles, counts))
                rest = np.cumsum(weights[order][::-1], dtype=float)[::-1]
                keep = (rest >= least * rest[0]) & (counts[order] > 1)
                for column, values in zip(columns, (shingles[order][keep], np.full(keep.sum(), rest[0]), rest[keep]), strict=True):
                    column.append(values)
                lengths.append(int(keep.sum()))
            again = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            shingle, size, rest = (pa.array(np.concatenate(c)) for c in columns)
            yield {
                "shingle": shingle.cast(pa.int64()),
                "key": batch.column(2).take(again),
                "class": batch.column(3).take(again),
                "size": size,
                "rest": rest,
            }

    filed = materialize(map_batches(rows, file, "shingle bigint, key binary, class binary, size double, rest double"), "filed")
    by_class = filed.groupBy("shingle", "class").agg(F.count("*").alias("n"))
    mixed = by_class.groupBy("shingle").agg(F.max_by("class", F.struct("n", "class")).alias("most"), F.count("*").alias("k")).filter("k > 1")
    placed = materialize(filed.join(mixed.drop("k"), "shingle"), "filed-mixed")
    left = placed.filter(F.col("class") != F.col("most")).select(
        "shingle", F.col("key").alias("a"), F.col("class").alias("_class"), F.col("size").alias("_size"), F.col("rest").alias("_rest")
    )
    may_link = F.least("rest", "_rest") * (1 + least) >= (F.col("size") + F.col("_size")) * least
    once = (F.col("class") == F.col("most")) | (F.col("a") < F.col("key"))
    pairs = left.join(placed, (left["shingle"] == placed["shingle"]) & (F.col("class") != F.col("_class")) & once & may_link)
    return _ordered(pairs.select("a", F.col("key").alias("b")))


def _with_class(rows: DataFrame, roots: DataFrame | None, column: str) -> DataFrame:
    """Replace the class in ``column`` by the root it was joined to."""
    if roots is None:
        return rows
    joined = rows.join(roots, rows[column] == roots["u"], "left")
    return joined.withColumn(column, F.coalesce("root", column)).drop("u", "root")


def classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    min_similarity: float = MIN_SIMILARITY,
    common: float = COMMON,
    idf_range: float = IDF_RANGE,
) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id (least doc_id of the class), kept and
    has_words."""
    prepare(docs.sparkSession)
    text = text_or_empty(text_col)
    keys, shared = sketch(docs, id_col, text_col, shingle, common, idf_range)
    sources = docs.select(F.col(id_col).alias("_id0"), F.xxhash64(text).alias("_hash0"), text.alias("_text"))
    vertices = keys.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("bands").alias("bands"))
    rows = vertices.select("key", F.explode("bands").alias("bucket"))
    shared_buckets = rows.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select("bucket")
    buckets = materialize(rows.join(shared_buckets, "bucket"), "buckets")
    chosen = buckets.select("key").distinct()
    payload = materialize(_shingles_of(sources, keys, chosen, shared, shingle, idf_range), "shingles")
    labels, tried = keys.select("doc_id", "text_hash", F.col("key").alias("class")), None
    members = buckets.withColumn("class", F.col("key"))
    for turn in range(3):
        if turn < 2:
            pairs = _near_pairs(members, turn) if turn else _leader_pairs(buckets)
        else:
            pairs = _exact_pairs(members, payload, min_similarity)
        if pairs is None:
            break
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        found = materialize(_verified(pairs, payload, min_similarity), f"compared-{turn}")
        compared = found.select("u", "v")
        tried = compared if tried is None else tried.unionByName(compared)
        links = found.filter("linked").select("u", "v")
        if links.isEmpty():
            continue
        # Links between the classes so far; a class is joined to the least of those it reaches.
        if turn:
            now = members.select("key", "class").distinct()
            for end in ("u", "v"):
                links = links.join(now.select(F.col("key").alias(end), F.col("class").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
        roots = components(links)
        members = materialize(_with_class(members, roots, "class"), f"members-{turn}")
        labels = materialize(_with_class(labels, roots, "class"), f"labels-{turn}")
    labelled = labels
    # The least row of each class; NULL ids sort last.
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    firsts = labelled.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min(place).alias("_first"))
    out = labelled.join(firsts, "class", "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.coalesce(F.col("_first.doc_id"), F.col("doc_id")).alias("class_id"),
        (F.col("class").isNull() | (F.col("_first") == place)).alias("kept"),
        F.col("class").isNotNull().alias("has_words"),
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with all columns of ``docs``."""
    found = classes(docs, id_col=id_col, text_col=text_col, **options).filter("kept")
    key, text_hash, words, copies, own = (free_name(n, docs.columns) for n in ("_kept_id", "_kept_hash", "_words", "_copies", "_own_hash"))
    counted = found.groupBy("doc_id", "text_hash", "has_words").agg(F.count("*").alias("_n"))
    kept = materialize(counted, "kept").toDF(key, text_hash, words, copies)
    # A row without words is a class of its own, and so stays however often it occurs.
    rows = docs.withColumn(own, F.xxhash64(text_or_empty(text_col)))
    chosen = rows.join(kept, rows[id_col].eqNullSafe(kept[key]) & (rows[own] == kept[text_hash]))
    out = chosen.filter((F.col(copies) == 1) | ~F.col(words))
    if not kept.filter(F.col(copies) > 1).isEmpty():
        # Rows equal in id and text: only these are shuffled to leave one of each.
        twice = chosen.filter((F.col(copies) > 1) & F.col(words))
        out = out.unionByName(twice.dropDuplicates([key, text_hash]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
