import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from forgelake.llm import near_dedup
from forgelake.llm.components import components
from forgelake.llm.words import WORD, each_text, shingle_hashes


def sentence(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"e{rng.randrange(10**6)}"
    return words


def shingles(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_draws_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        agree = total = 0
        for _ in range(60):
            n = 300
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            other = base.copy()
            k = round(n * (1 - share) / (1 + share))
            other[:k] = rng.integers(0, 2**63, k).astype(np.uint64)
            w = np.ones(n, np.float32) * 1.25
            agree += (near_dedup.draw(base, w) == near_dedup.draw(other, w)).sum()
            total += len(near_dedup._ODD)
        assert abs(agree / total - share) < 0.03


def test_draws_follow_weights():
    # Weights 1 and 2 on the same shingles: the weighted similarity is one half.
    rng = np.random.default_rng(1)
    agree = total = 0
    for _ in range(60):
        s = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = np.ones(200, np.float32), np.full(200, 2, np.float32)
        agree += (near_dedup.draw(s, a) == near_dedup.draw(s, b)).sum()
        total += len(near_dedup._ODD)
    assert abs(agree / total - 0.5) < 0.03


def test_weighted_jaccard_by_hand():
    a = (np.array([1, 2, 3], np.uint64), np.array([1, 2, 1], np.float32))
    b = (np.array([2, 3, 9], np.uint64), np.array([1, 3, 1], np.float32))
    assert near_dedup.weighted_jaccard(a, b) == 2 / 7
    assert near_dedup.weighted_jaccard(a, a) == 1


def test_components_of_a_path_a_star_and_a_pair(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 200)]
    rows = [*path, *star, (500, 499), (499, 500), (7, 7)]
    found = {r["u"]: r["root"] for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 200)}, 500: 499}


def test_classes_match_brute_force(documents):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = sentence(rng, 120)
        for edits in (0, 0, 1, 2, 4, 12, 30):
            rows.append((n, " ".join(edited(rng, base, edits))))
            n += 1
    docs = documents(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    texts, root = dict(rows), {i: i for i in range(n)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in range(n)}


def test_a_large_group_of_near_copies_stays_together(documents):
    rng = random.Random(5)
    base = sentence(rng, 150)
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(120)] + [(1000 + i, " ".join(sentence(rng, 60))) for i in range(100)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(rows)).collect()}
    assert {got[i] for i in range(120)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(100))


def test_corner_cases(documents):
    rng = random.Random(6)
    text = " ".join(sentence(rng, 30))
    rows = [(1, None), (2, ""), (3, " . "), (4, "one two"), (5, "One, two!"), (6, text), (6, text), (None, text), (7, text.upper())]
    got = sorted(near_dedup.classes(documents(rows)).select("doc_id", "class_id").collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [(r[0], r[1]) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (6, 6), (7, 6), (None, 6)]
    kept = near_dedup.deduplicate(documents(rows, "'z' AS class_id")).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [1, 2, 3, 4, 6]
    assert near_dedup.classes(documents([])).count() == 0
    assert near_dedup.deduplicate(documents([])).count() == 0


def test_common_shingles_counts(documents):
    docs = documents([(i, f"a b c d e x{i} y{i} z{i}") for i in range(200)]).repartition(3)
    counts = near_dedup.common_shingles(docs.select("text"), 5, 0.01)
    assert counts.agg(F.sum("rows")).first()[0] == 200
    assert max(r["n"] for r in counts.collect()) == 200


def test_common_shingles_are_counted_exactly_however_the_rows_are_dealt_out(documents):
    """A shingle that is common in all rows need not come twice in any part of them."""
    rng = random.Random(9)
    passages = [sentence(rng, 5) for _ in range(40)]
    # The k-th passage is in every (k + 2)-th row: shares from a half down to 1 in 41, on both sides of the border.
    rows = [(i, " . ".join(" ".join([*p, *sentence(rng, 6)]) for k, p in enumerate(passages) if i % (k + 2) == 0) + f" end{i}") for i in range(400)]
    words = {i: list(each_text([t]))[0] for i, t in rows}
    want = Counter(h for w in words.values() for h in np.unique(shingle_hashes(w, 5)).view(np.int64).tolist())
    want = {h: n for h, n in want.items() if n > 0.04 * 400}
    assert len(want) == 23
    for parts in (1, 7, 80, 400):
        found = near_dedup.common_shingles(documents(rows).repartition(parts).select("text"), 5, 0.04)
        assert {r["hash"]: r["n"] for r in found.filter("rows = 0").collect()} == want
        assert found.agg(F.sum("rows")).first()[0] == 400


def test_counts_that_a_task_gives_on_early_are_added_up(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "FOLD", 20)
    docs = documents([(i, " ".join(f"a{j}" for j in range(60)) + f" x{i}") for i in range(30)]).coalesce(1)
    found = near_dedup.common_shingles(docs.select("text"), 5, 0.5)
    assert sorted(r["n"] for r in found.filter("rows = 0").collect()) == [30] * 56


def test_a_crowded_bucket_is_compared_as_by_brute_force(documents):
    """Most texts are one passage and a long own part, too long to be alike; a few with a short own part are."""
    rng = random.Random(8)
    passage = sentence(rng, 160)
    rows = [(i, " ".join([*passage, *sentence(rng, 36)])) for i in range(300)]
    # Only with each other above 0.8, and what they share is in all texts; the second kind lacks a piece of the passage.
    rows += [(300 + i, " ".join([*passage, *sentence(rng, 4)])) for i in range(6)]
    rows += [(400 + i, " ".join([*passage[:118], *sentence(rng, 3)])) for i in range(6)]
    texts = dict(rows)
    sets = {i: shingles(t) for i, t in texts.items()}
    # No shingle counts as common, so all weigh the same.
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(documents(rows), common=2.0).collect()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    below = above = 0
    for i in texts:
        for j in filter(i.__gt__, texts):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            above, below = above + (alike >= 0.8), below + (0.6 < alike < 0.8)
            if alike >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert above == 30 and below > 1000 and len({find(i) for i in texts}) == 302
    assert got == {i: find(i) for i in texts}
