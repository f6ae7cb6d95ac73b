"""Toxicity by a convolutional text classifier trained in numpy (operator 10).

A word's vector is the mean of hashed embeddings: one for the word and one for each of its character
5-grams, so that unseen forms of a known stem have a meaning. Filters of widths 1, 2 and 3 run over the
words, each filter keeps its highest value in the text (max pooling), and a logistic unit weighs these.
As filters are linear, each distinct word is multiplied with them once per worker; a text is then sums of
looked-up rows.

Training takes at most about ``MAX_ROWS`` labelled rows of each class, chosen by a hash of the id, in one
task; a fifth of them is kept aside to calibrate. Calibration sets a threshold per language, as guessed
from function words of the text itself, and one slope: a score of 0.5 is the threshold. Prediction reads
every text whole.

Defined results: a NULL or empty text is scored like any other, from the bias alone. Labels that are
NULL, or of ids without a document, are not learned from; of several labels of an id the highest counts.
Without rows of both classes every score is the share of the class seen, 0 if none. Repeated rows are
scored one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelake.llm.common import map_batches, prepare
from forgelake.llm.words import WORD
from forgelake.session import materialize

# Labelled rows of each class that training reads, about.
MAX_ROWS = 2000
BUCKETS = 1 << 17
DIMENSIONS = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 3
# Training texts a hashed row must occur in; rarer rows stay zero, as they could only be learned by heart.
MIN_TEXTS = 3
# Texts at which a row's first value is half its log-odds.
SHRINK = 4
# Steps that training takes at least, in further epochs where the sample is small.
MIN_STEPS = 60
BATCH = 32
RATE = 0.03
# Rows of a language that calibration needs of either class, else the threshold of all languages holds.
MIN_CALIBRATION = 20
GRAM = 5
MAX_WORDS = 300_000

# Frequent function words, as plain lists; only to guess which threshold a text takes.
FUNCTION_WORDS = {
    "de": "auf das dem den der des die ein eine ist im in mit nicht sich und von zu".split(),
    "en": "and are as at be for is it of on or that the this to was with you".split(),
    "es": "como con de del el en es la las los no para por que se su un una y".split(),
    "fr": "au avec dans de des du elle en est et la le les pas pour qui sur un une".split(),
}


def word_features(word: str) -> list[int]:
    """Hashed rows of a word: the word itself and its 5-grams of bytes with its borders."""
    marked = b"<" + word.encode("utf-8", "surrogatepass") + b">"
    return [crc32(marked, 1) % BUCKETS] + [crc32(marked[i : i + GRAM]) % BUCKETS for i in range(len(marked) - GRAM + 1)]


LANGUAGES = sorted(FUNCTION_WORDS)
_NUMBERS = {w: [i for i, lang in enumerate(LANGUAGES) if w in FUNCTION_WORDS[lang]] for words in FUNCTION_WORDS.values() for w in words}


def language_mask(word: str) -> np.ndarray:
    """1 for each language the word is a function word of."""
    mask = np.zeros(len(LANGUAGES), np.int8)
    mask[_NUMBERS.get(word, [])] = 1
    return mask


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the ranges that begin at ``starts`` and hold ``counts`` entries, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Network:
    """Embeddings, filters and output weights; trained by Adagrad."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        offsets = sum(WIDTHS)
        self.embeddings = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32)
        # One block of columns per (width, offset in the window).
        self.filters = rng.normal(0, 0.3, (DIMENSIONS, offsets * FILTERS)).astype(np.float32)
        self.biases = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.output = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.sums = {n: np.full_like(getattr(self, n), 1e-3) for n in ("embeddings", "filters", "biases", "output", "bias")}

    def start(self, texts: list[np.ndarray], labels: np.ndarray, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """First values from document counts: the first dimension of a row is its log-odds of the classes,
        drawn to zero where texts are few; rows of too few texts stay zero for good."""
        seen = np.zeros((2, BUCKETS))
        for text, label in zip(texts, labels.tolist(), strict=True):
            words = np.unique(text)
            seen[label, np.unique(flat[ragged(starts[words], counts[words])])] += 1
        totals = np.bincount(labels, minlength=2)
        odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
        self.frequent = seen.sum(0) >= MIN_TEXTS
        self.embeddings[:, 0] = 0.3 * odds * seen.sum(0) / (seen.sum(0) + SHRINK)
        self.embeddings[~self.frequent] = 0
        self.filters[0, : FILTERS] = np.abs(self.filters[0, : FILTERS]) + 0.5
        self.output[:FILTERS] = np.abs(self.output[:FILTERS])

    def vectors(self, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean embedding of each word, from its feature rows laid end to end."""
        return np.add.reduceat(self.embeddings[flat], starts, axis=0) / counts[:, None].astype(np.float32)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.filters

    def pool(self, projected: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest value of each filter over the text, and where; words beyond the end count as zero."""
        if not len(ids):
            return np.zeros(len(self.biases), np.float32), np.full(len(self.biases), -1)
        rows = projected[ids]
        tops, at, column = [], [], 0
        for width in WIDTHS:
            total = rows[:, column : column + FILTERS].copy()
            for offset in range(1, width):
                column += FILTERS
                if len(ids) > offset:
                    total[:-offset] += rows[offset:, column : column + FILTERS]
            column += FILTERS
            best = total.argmax(0)
            at.append(best)
            tops.append(total[best, np.arange(FILTERS)])
        return np.concatenate(tops), np.concatenate(at)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.biases, 0) @ self.output + self.bias[0]

    def _step(self, name: str, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        value, total = getattr(self, name), self.sums[name]
        if rows is None:
            total += gradient**2
            value -= RATE * gradient / np.sqrt(total)
        else:
            total[rows] += gradient**2
            value[rows] -= RATE * gradient / np.sqrt(total[rows])

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """One step over a batch; ``texts`` are word numbers, the rest their feature rows end to end."""
        words, inverse = np.unique(np.concatenate(texts), return_inverse=True)
        if not len(words):
            return
        n = counts[words]
        rows = flat[ragged(starts[words], n)]
        vectors = self.vectors(rows, np.cumsum(n) - n, n)
        projected = self.project(vectors)
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        pooled, at = (
            np.stack(x)
            for x in zip(*(self.pool(projected, inverse[b : b + m]) for b, m in zip(begins, sizes, strict=True)), strict=True)
        )
        hidden = np.maximum(pooled + self.biases, 0)
        error = (1 / (1 + np.exp(-self.logit(pooled))) - labels) / len(texts)
        back = error[:, None] * self.output * (hidden > 0)
        gradient_filters, gradient_vectors = np.zeros_like(self.filters), np.zeros_like(vectors)
        block = 0
        for k, width in enumerate(WIDTHS):
            places, g = at[:, k * FILTERS : (k + 1) * FILTERS], back[:, k * FILTERS : (k + 1) * FILTERS]
            for offset in range(width):
                good = (places >= 0) & (places + offset < sizes[:, None]) & (g != 0)
                text, column = np.nonzero(good)
                word = inverse[begins[text] + places[good] + offset]
                pushed = g[good][:, None]
                columns = block * FILTERS + column
                np.add.at(gradient_filters.T, columns, vectors[word] * pushed)
                np.add.at(gradient_vectors, word, pushed * self.filters[:, columns].T)
                block += 1
        touched = np.flatnonzero(np.any(gradient_vectors, axis=1))
        if len(touched):
            spread = np.repeat(gradient_vectors[touched] / n[touched, None], n[touched], axis=0)
            places, number = np.unique(flat[ragged(starts[words[touched]], n[touched])], return_inverse=True)
            summed = np.zeros((len(places), DIMENSIONS), np.float32)
            np.add.at(summed, number, spread)
            learned = self.frequent[places]
            self._step("embeddings", summed[learned], places[learned])
        self._step("filters", gradient_filters)
        self._step("biases", back.sum(0))
        self._step("output", (error[:, None] * hidden).sum(0))
        self._step("bias", np.array([error.sum()], np.float32))


class Classifier:
    """A trained network with its calibration; ``share`` stands in where nothing could be trained."""

    def __init__(self, network: Network | None, share: float = 0.0):
        self.network, self.share = network, share
        self.slope, self.threshold, self.thresholds = 1.0, 0.0, {}
        if network is not None:
            network.sums = {}
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int | tuple[int, ...]] = {}
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, sum(WIDTHS) * FILTERS), np.float32)
        self.masks = np.zeros((0, len(LANGUAGES)), np.int8)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "known", "rows", "masks")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def _learn_words(self, pieces: set[str]) -> None:
        split = {p: WORD.findall(p) for p in pieces}
        new = list({w: None for words in split.values() for w in words if w not in self.known})
        if new:
            features = [word_features(w) for w in new]
            counts = np.array([len(f) for f in features])
            flat = np.concatenate(features)
            vectors = self.network.vectors(flat, np.append(0, np.cumsum(counts)[:-1]), counts)
            at = len(self.known)
            if at + len(new) > len(self.rows):
                more = at + 2 * len(new)
                self.rows = np.concatenate([self.rows[:at], np.zeros((more, self.rows.shape[1]), np.float32)])
                self.masks = np.concatenate([self.masks[:at], np.zeros((more, len(LANGUAGES)), np.int8)])
            self.rows[at : at + len(new)] = self.network.project(vectors)
            for i, word in enumerate(new, at):
                if word in _NUMBERS:
                    self.masks[i] = language_mask(word)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        for piece, words in split.items():
            ids = tuple(self.known[w] for w in words)
            self.index[piece] = ids[0] if len(ids) == 1 else ids

    def logit(self, text: str) -> tuple[float, str]:
        """Raw value and guessed language of a text."""
        pieces = text.lower().split()
        if len(self.known) > MAX_WORDS or len(self.index) > 2 * MAX_WORDS:
            self._reset()
        ids = list(map(self.index.get, pieces))
        if None in ids:
            self._learn_words({p for p, i in zip(pieces, ids, strict=True) if i is None})
            ids = list(map(self.index.get, pieces))
        try:
            numbers = np.fromiter(ids, np.int64, len(ids))
        except TypeError:
            numbers = np.array([j for i in ids for j in (i if isinstance(i, tuple) else (i,))], np.int64)
        pooled, _ = self.network.pool(self.rows, numbers)
        counts = self.masks[numbers].sum(0, dtype=np.int64)
        lang = LANGUAGES[int(counts.argmax())] if counts.any() else "other"
        return float(self.network.logit(pooled)), lang

    def score(self, text: str) -> float:
        if self.network is None:
            return self.share
        value, lang = self.logit(text)
        z = self.slope * (value - self.thresholds.get(lang, self.threshold))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    def calibrate(self, texts: list[str], labels: np.ndarray) -> None:
        values, langs = zip(*(self.logit(t) for t in texts), strict=True)
        values, langs = np.array(values), np.array(langs)
        self.threshold = best_threshold(values, labels)
        for lang in sorted(set(langs.tolist())):
            mine = langs == lang
            if min(labels[mine].sum(), (1 - labels[mine]).sum()) >= MIN_CALIBRATION:
                self.thresholds[lang] = best_threshold(values[mine], labels[mine])
        moved = values - np.array([self.thresholds.get(x, self.threshold) for x in langs.tolist()])
        # The slope that makes the held-out labels likeliest.
        slopes = np.geomspace(0.05, 20, 60)
        loss = [np.logaddexp(0, -(2 * labels - 1) * s * moved).sum() for s in slopes]
        self.slope = float(slopes[int(np.argmin(loss))])


def best_threshold(values: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best sum of both classes' shares of right answers; the middle of the best gap."""
    order = np.argsort(values, kind="stable")
    v, y = values[order], labels[order]
    below = np.append(0, np.cumsum(1 - y)) / max(1, (1 - y).sum()) - np.append(0, np.cumsum(y)) / max(1, y.sum())
    edges = np.concatenate([[v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]])
    best = np.flatnonzero(below >= below.max() - 1e-12)
    return float(np.median(edges[best]))


def fit(texts: list[str], labels: np.ndarray, seed: int = 0) -> Classifier:
    """Train on four fifths of the rows and calibrate on the rest."""
    if len(texts) == 0 or labels.min() == labels.max():
        return Classifier(None, float(labels.mean()) if len(texts) else 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    aside = order[: len(order) // 5]
    train = order[len(order) // 5 :]
    if len(set(labels[train].tolist())) < 2 or len(set(labels[aside].tolist())) < 2:
        aside = train = order
    numbers: dict[str, int] = {}
    words = [np.array([numbers.setdefault(w, len(numbers)) for w in WORD.findall(texts[i].lower())], np.int64) for i in train]
    features = [word_features(w) for w in numbers]
    counts = np.array([len(f) for f in features])
    flat, starts = np.array([x for f in features for x in f]), np.cumsum(counts) - counts
    network = Network(seed)
    network.start(words, labels[train], flat, starts, counts)
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(train)))):
        turn = rng.permutation(len(train))
        for start in range(0, len(turn), BATCH):
            chosen = turn[start : start + BATCH]
            network.learn([words[i] for i in chosen], labels[train[chosen]].astype(np.float32), flat, starts, counts)
    found = Classifier(network)
    found.calibrate([texts[i] for i in aside], labels[aside].astype(float))
    return found


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_rows: int = MAX_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Classifier:
    """Fit on a bounded sample of the labelled rows of ``docs``."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Classifier(None)
    share = F.create_map(*(F.lit(x) for k, n in totals.items() for x in (k, min(1.0, max_rows / n))))
    chosen = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share[F.col("_label")] * 1_000_000)
    # At most about ``max_rows`` ids of each class.
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    sample = materialize(rows.join(F.broadcast(chosen), "_id").select("_id", "_text", "_label"), "labelled-sample")

    def run(batches) -> Iterator[dict[str, list]]:
        texts, found = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            found += batch.column(1).to_pylist()
        yield {"model": [pickle.dumps(fit(texts, np.array(found, np.int64)))]}

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_text").select("_text", "_label")
    model = materialize(map_batches(ordered, run, "model binary"), "classifier").collect()
    return pickle.loads(bytes(model[0]["model"])) if model else Classifier(None)


def predict(docs: DataFrame, model: Classifier, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row with ``score`` and ``predicted``; reads nothing else but the text."""
    spark = prepare(docs.sparkSession)
    kept = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    shared = spark.sparkContext.broadcast(model)
    names = [f.name for f in kept.schema.fields[:-1]]

    def run(batches) -> Iterator[dict[str, list]]:
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column(len(names)).to_pylist()]
            yield {
                **{n: batch.column(i) for i, n in enumerate(names)},
                "score": scores,
                "predicted": [int(s >= 0.5) for s in scores],
            }

    return map_batches(kept, run, kept.drop("_text").schema.add("score", "double").add("predicted", "integer"))
