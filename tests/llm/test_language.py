import random

import numpy as np
import pytest

from forgelake.llm import language

ALPHABETS = {"aa": "bcdaeiou", "bb": "fghaeiou", "cc": "lmnaeiou"}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choices(ALPHABETS[lang], k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture
def corpus(documents):
    rng = random.Random(1)
    rows = [(i, text(rng, lang), lang, None) for i, lang in enumerate(list(ALPHABETS) * 60)]
    return documents(rows)


def test_ngrams_stay_within_words():
    one, two = language.ngram_hashes("ab cd", (2, 3)), language.ngram_hashes("cd ab", (2, 3))
    assert sorted(one.tolist()) == sorted(two.tolist())
    # " a", "ab", "b " and " ab", "ab " for each word.
    assert len(one) == 10
    assert len(language.ngram_hashes("", (1, 2, 3))) == 0
    assert (language.ngram_hashes("A-b", (1,)) == language.ngram_hashes("a b", (1,))).all()


def test_filter_returns_all_languages_that_hold_an_ngram():
    hashes = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = 1 << 14
    bits = np.zeros(rows, np.uint8)
    for i, h in enumerate(hashes):
        for at in language.filter_rows(np.array([h]), rows):
            bits[at] |= 1 << (i % 3)
    masks = bits[language.filter_rows(hashes, rows)[0]]
    for at in language.filter_rows(hashes, rows)[1:]:
        masks = masks & bits[at]
    assert all(m & (1 << (i % 3)) for i, m in enumerate(masks.tolist()))


def test_held_out_texts_are_recognised(corpus):
    held = language.fold("doc_id", 4) == 2
    model = language.train(corpus.filter(~held))
    rows = language.predict(corpus.filter(held), model, ["doc_id", "lang"]).collect()
    assert rows and all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in rows)


def test_predictions_do_not_depend_on_other_columns(corpus, documents):
    model = language.train(corpus)
    rng = random.Random(9)
    same = text(rng, "bb")
    rows = language.predict(documents([(1, same, "aa", "x"), (2, same, None, None)]), model, ["doc_id"]).collect()
    assert len({(r["lang_pred"], r["score"]) for r in rows}) == 1


def test_corner_cases(corpus, documents):
    model = language.train(corpus, max_rows=10)
    rows = [(1, None), (2, ""), (3, "12 ?! ½"), (4, "日本語"), (5, "b" * 3_000_000), (None, "fgh")]
    found = {r["doc_id"]: r for r in language.predict(documents(rows, "1 AS score2"), model, ["doc_id"]).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert found[4]["score"] == 0 and found[4]["lang_pred"] == "aa"
    assert found[5]["lang_pred"] == "aa" and found[None]["lang_pred"] == "bb"
    nothing = language.train(documents([(1, "a b", None, None)]))
    assert [r["lang_pred"] for r in language.predict(documents(rows[:4]), nothing, ["doc_id"]).collect()] == ["und"] * 4
    assert language.predict(documents([]), model, ["doc_id"]).count() == 0


def test_more_languages_than_a_slice_has_bits(documents):
    rows = [(i, f"w{chr(0x4E00 + i % 70)}{chr(0x5E00 + i % 70)}" * 2, f"l{i % 70:02}", None) for i in range(280)]
    model = language.train(documents(rows))
    assert len(model.slices) == 2
    found = language.predict(documents(rows), model, ["lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)


def test_training_reads_all_rows_of_a_large_language(documents):
    """Each rare letter is in 9 of 30,000 texts: often enough when all are counted, a matter of luck in a sample."""
    rare = [chr(0x4E00 + i) for i in range(40)]
    rows = [(i, f"fgh {rare[i % 1000]}" if i % 1000 < 40 and i < 9000 else f"abc{i % 7}", "aa", None) for i in range(30_000)]
    model = language.train(documents(rows))
    assert all(model.hits(letter)[1][0] == model.hits(letter)[0] for letter in rare)
    # One text less, and it is too rare for a language of that size.
    once = [(i, f"fgh {rare[0]}" if i < 8 else f"abc{i % 7}", "aa", None) for i in range(30_000)]
    found = language.train(documents(once)).hits(rare[0])
    assert found[1][0] < found[0]
