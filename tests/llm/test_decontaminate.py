import random

import numpy as np
import pytest

from forgelake.llm import decontaminate
from forgelake.llm.words import WORD, word_hashes


def words(rng, n):
    return [f"w{rng.randrange(10**5)}" for _ in range(n)]


def plain_smith_waterman(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_matches_the_plain_table():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = (rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        score, start, end = decontaminate.align(a, b)
        assert score == plain_smith_waterman(a.tolist(), b.tolist())
        assert score == plain_smith_waterman(a.tolist(), b[start:end].tolist())


@pytest.mark.parametrize("text", ["", "one", "a-b c. ! D", "it's  x\ty\nz"])
def test_word_hashes_follow_the_words(text):
    assert word_hashes(text).tolist() == [decontaminate.word_hashes(w)[0] for w in WORD.findall(text.lower())]


@pytest.fixture
def benchmark(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(words(rng, 30))) for i in range(8)] + [(100, None), (101, ""), (102, "short item"), (103, None)]
    rows[3] = (3, rows[2][1])
    return spark.createDataFrame(rows, "item_id long, text string")


def found(docs, benchmark, **options):
    rows = decontaminate.find(docs, benchmark, **options).collect()
    return {r["doc_id"]: {m["item_id"]: m["score"] for m in r["_matches"]} for r in rows}


def test_copies_edited_copies_and_clean_documents(documents, benchmark):
    rng = random.Random(4)
    items = {r["item_id"]: (r["text"] or "").split() for r in benchmark.collect()}
    around = lambda x: " ".join([*words(rng, 50), *x, *words(rng, 50)])
    changed = list(items[1])
    for i in (4, 11, 19, 26):
        changed[i] = "other"
    shifted = items[4][:10] + ["put", "in"] + items[4][12:]
    rows = [
        (1, around(items[0]).upper()),
        (2, around(changed)),
        (3, around(shifted)),
        (4, around(items[2])),
        (5, around(items[5][:9])),
        (6, around([])),
        (7, None),
        (8, ""),
        (9, "x short item y"),
        (10, around([*items[0], *items[6]])),
    ]
    got = found(documents(rows, "'c' AS score"), benchmark)
    assert got[1] == {0: 1.0} and set(got[2]) == {1} and 0.7 < got[2][1] < 1 and set(got[3]) == {4}
    assert got[4] == {2: 1.0, 3: 1.0} and got[10] == {0: 1.0, 6: 1.0} and got[9] == {102: 1.0}
    assert not any(got[i] for i in (5, 6, 7, 8))
    kept = decontaminate.clean(documents(rows), benchmark)
    assert kept.columns == documents(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 6, 7, 8]


def test_a_passage_in_every_document_is_still_found(documents, benchmark):
    rng = random.Random(5)
    item = benchmark.filter("item_id = 7").first()["text"]
    docs = documents([(i, " ".join([*words(rng, 20), item])) for i in range(200)])
    assert all(v == {7: 1.0} for v in found(docs, benchmark).values())


def test_blocks_of_items_give_the_same_rows(documents, benchmark):
    rng = random.Random(6)
    items = {r["item_id"]: r["text"] for r in benchmark.collect() if r["text"]}
    docs = documents([(i, " ".join([*words(rng, 20), t, *words(rng, 9)])) for i, t in items.items()])
    assert found(docs, benchmark, block_words=40) == found(docs, benchmark)


def test_spans_name_the_passage(documents, benchmark):
    item = benchmark.filter("item_id = 0").first()["text"]
    row = decontaminate.find(documents([(1, f"Before, {item}. After")]), benchmark).first()["_matches"][0]
    assert (row["start_word"], row["n_words"], row["passage"]) == (1, 30, item)


def test_empty_tables(documents, benchmark):
    assert found(documents([]), benchmark) == {}
    assert found(documents([(1, "a b c")]), benchmark.limit(0)) == {1: {}}


@pytest.mark.parametrize("every", [2, 3, 4, 5])
@pytest.mark.parametrize("edit", ["replace", "insert", "drop"])
def test_an_edited_copy_that_is_the_only_trace_scores_as_in_the_plain_table(every, edit):
    """Edits up to and beyond the threshold; few or no 3-grams of the item are left in any document."""
    rng = random.Random(every)
    passed = 0
    for n in (5, 12, 30, 31):
        item = words(rng, n)
        copy = []
        for i, w in enumerate(item):
            changed = i % every == every - 1
            copy += [w, "new"] if changed and edit == "insert" else [w] if not changed else ["new"] * (edit == "replace")
        text = [*words(rng, 40), *copy, *words(rng, 40)]
        items = decontaminate.Items.of([(0, " ".join(item)), (1, " ".join(words(rng, 30)))])
        got = {k: s for k, s, _, _ in decontaminate.matches(word_hashes(" ".join(text)), items, 0.5)}
        want = plain_smith_waterman(item, text) / (2 * n)
        assert got == ({0: want} if want >= 0.5 else {})
        passed += want >= 0.5
    assert passed == 4 or (every, edit) in {(2, "replace"), (3, "replace"), (2, "drop")}


def test_all_documents_and_items_of_a_small_vocabulary_match_the_plain_table():
    rng = random.Random(9)
    items = [[f"v{rng.randrange(30)}" for _ in range(rng.randrange(3, 14))] for _ in range(20)]
    held = decontaminate.Items.of([(i, " ".join(x)) for i, x in enumerate(items)])
    some = 0
    for n in range(60):
        text = [f"v{rng.randrange(30)}" for _ in range(rng.randrange(1, 60))]
        got = {k: s for k, s, _, _ in decontaminate.matches(word_hashes(" ".join(text)), held, 0.5)}
        scores = {i: plain_smith_waterman(x, text) / (2 * len(x)) for i, x in enumerate(items)}
        assert got == {i: s for i, s in scores.items() if s >= 0.5}
        some += len(got)
    assert some > 20


def test_a_query_finds_an_edited_copy_without_half_of_its_3_grams(documents, benchmark):
    rng = random.Random(10)
    item = benchmark.filter("item_id = 6").first()["text"].split()
    copy = ["other" if i % 4 == 3 else w for i, w in enumerate(item)]
    got = found(documents([(1, " ".join([*words(rng, 50), *copy, *words(rng, 50)])), (2, " ".join(words(rng, 90)))]), benchmark)
    assert got[1].keys() == {6} and 0.6 < got[1][6] < 0.7 and got[2] == {}
