import random

import numpy as np
import pyarrow as pa
import pytest

from forgelake.llm.tokens import Encoder, default_path

SIGNS = [*"aB1é.,;:!? \n\t<|>\x01\x1cćΣ'  ", "İ", "יִ", "́", "H̱", "한", "א", "ǅ", "ᄀ", "ᅡ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_ids_of_batches_are_those_of_whole_texts(tokenizer):
    encoder, rng = Encoder(default_path(), 60), random.Random(5)
    for _ in range(80):
        texts = ["".join(rng.choices(SIGNS, k=rng.choice([0, 1, 2, 5, 60]))) for _ in range(rng.randrange(10))]
        # A part of a larger array, as batches are.
        ids, lengths = encoder.flat(pa.array(["left. ", *texts, ". right"], pa.string())[1 : 1 + len(texts)])
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert lengths.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
        assert encoder.encode(texts) == [np.array(x, "<u4").tobytes() for x in want]


def test_repeated_words_are_looked_up_once_in_a_batch(monkeypatch):
    encoder, asked, given = Encoder(default_path()), [], []
    look, raw = encoder._ids, encoder._raw
    monkeypatch.setattr(encoder, "_ids", lambda words: asked.extend(words) or look(words))
    monkeypatch.setattr(encoder, "_raw", lambda texts: given.extend(texts) or raw(texts))
    encoder.flat(pa.array(["one two\nthree " * 500, "two, one"] * 3))
    assert len(asked) < 10
    # Words of letters go to the tokenizer once, and without a sign between them.
    assert sorted(" ".join(given).split()) == [",", "one", "three", "two"]


def test_letters_of_several_tokens_fall_back(tokenizer):
    # The second letter is taken apart by the normalizer: two words of the tokenizer.
    texts = ["a יִ b İ c", "יִb"]
    ids, _ = Encoder(default_path()).flat(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]
