import random

import numpy as np
import pytest

from forgelake.llm import language, toxicity

BAD = ["grumblefoo", "grumblebar", "snarkle"]


def text(rng, bad, n=40):
    words = ["".join(rng.choices("abcdeilmnorst", k=rng.randint(2, 6))) for _ in range(n)] + ["the", "and", "is"]
    if bad:
        words.insert(rng.randrange(len(words)), rng.choice(BAD))
    return " ".join(words)


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(0)
    labels = np.array([i % 3 == 0 for i in range(450)], np.int64)
    return [text(rng, y) for y in labels], labels


@pytest.fixture(scope="module")
def model(sample):
    return toxicity.fit(*sample)


def test_held_out_texts(model):
    rng = random.Random(7)
    for bad in (True, False):
        scores = [model.score(text(rng, bad)) for _ in range(100)]
        assert sum((s >= 0.5) == bad for s in scores) >= 95
    # An unseen form of a known stem.
    assert np.mean([model.score(text(rng, False) + " grumblezap") for _ in range(30)]) > np.mean(
        [model.score(text(rng, False) + " plainword") for _ in range(30)]
    )


def test_a_word_far_down_a_long_text_counts(model):
    rng = random.Random(8)
    assert model.score(text(rng, False, 30_000) + " " + text(rng, True)) >= 0.5


def test_pooling_matches_the_plain_sum():
    net = toxicity.Network(3)
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(20, toxicity.DIMENSIONS)).astype(np.float32)
    ids = rng.integers(0, 20, 11)
    pooled, at = net.pool(net.project(vectors), ids)
    want, column = [], 0
    for width in toxicity.WIDTHS:
        block = net.filters[:, column * toxicity.FILTERS : (column + width) * toxicity.FILTERS]
        column += width
        values = []
        for p in range(len(ids)):
            total = np.zeros(toxicity.FILTERS)
            for o in range(width):
                if p + o < len(ids):
                    total += vectors[ids[p + o]] @ block[:, o * toxicity.FILTERS : (o + 1) * toxicity.FILTERS]
            values.append(total)
        want.append(np.max(values, 0))
    assert np.allclose(pooled, np.concatenate(want), atol=1e-4)
    assert ((at >= 0) & (at < len(ids))).all()


def test_best_threshold():
    assert toxicity.best_threshold(np.array([0.0, 1, 2, 3]), np.array([0.0, 0, 1, 1])) == 1.5


def test_train_and_predict_on_tables(spark, documents, sample):
    texts, labels = sample
    docs = documents([(i, t) for i, t in enumerate(texts)])
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(0, None), (99999, 1), (None, 1)], "doc_id long, toxic int")
    held = language.fold("doc_id", 5) == 0
    found = toxicity.train(docs.filter(~held), marks.filter(~held))
    rows = toxicity.predict(docs.filter(held), found, ["doc_id"]).collect()
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.9
    odd = [(1, None), (2, ""), (3, "?!"), (4, texts[0]), (5, texts[0])]
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.predict(documents(odd, "1 AS score2"), found, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5]
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for s, p in got.values())
    assert toxicity.predict(documents([]), found, ["doc_id"]).count() == 0


@pytest.mark.parametrize("labels, want", [([], 0.0), ([1, 1], 1.0), ([0, 0, None], 0.0)])
def test_without_two_classes(spark, documents, labels, want):
    docs = documents([(i, f"text {i}") for i in range(3)])
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    found = toxicity.train(docs, marks)
    assert {r["score"] for r in toxicity.predict(docs, found, ["doc_id"]).collect()} == {want}
