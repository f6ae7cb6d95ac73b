import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from forgelake.llm import bpe, queries

RANKS = bpe.read_ranks(bpe.default_path())
LIBRARY = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=RANKS, special_tokens={})
PIECES = [
    "The quick brown fox", " it's", " 12345", "\n\n", "   ", "\t", "don't", "ÀÉ", "été", "naïve", "日本語", "🙂", "👩‍👩‍👧", "́", "ſ", "<|endoftext|>",
    "aaaaaaaaaaaa", "....", "=-=-", "\x00", "\x1c", " ", "　", "ﬀ", "१२", "Ⅷ", "\r\n", "x" * 40, "ß" * 9, "http://a.b/c?d=e&f", " ",
]


def some_text(seed, n=40):
    rng = random.Random(seed)
    return "".join(rng.choice([*PIECES, " ", chr(rng.randrange(0x20, 0x2FFF))]) for _ in range(n))


def ids_of(text):
    return np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()


def test_ids_are_those_of_the_library():
    own = bpe.encoder(bpe.default_path(), bpe.default_pattern())
    for text in ["", " ", "a", *PIECES, *(some_text(i) for i in range(400)), "ab" * 3000, "é" * 1000]:
        assert own.encode(text) == ids_of(text)


@pytest.mark.parametrize("seed", range(12))
def test_transducer_equals_merging_for_any_vocabulary(seed):
    # A small alphabet makes many overlapping merges; ranks follow merging, as in a trained vocabulary.
    rng = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    letters = "ab" if seed % 2 else "abc"
    while len(ranks) < 256 + 30:
        data = "".join(rng.choices(letters, k=300)).encode()
        parts = bpe.Transducer(ranks).merge(data)[0]
        pairs = [a + b for a, b in zip(parts, parts[1:], strict=False) if len(a + b) < 12]
        ranks.setdefault(rng.choice(pairs), len(ranks))
    own, library = bpe.Transducer(ranks, max_states=rng.choice([5, 50, 5000])), tiktoken.Encoding("x", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    for n in [1, 2, 3, 5, 9, 30, 200]:
        for _ in range(30):
            text = "".join(rng.choices(letters, k=n))
            assert own.piece(text.encode()) == library.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(12))
def test_pieces_side_by_side_are_as_alone(seed, monkeypatch):
    rng = random.Random(seed)
    # Steps that are made at once, soon or late; few places, so that pairs take one another's.
    monkeypatch.setattr(bpe, "WORTH_TOGETHER", rng.choice([1, 2, 32]))
    monkeypatch.setattr(bpe, "PLACES", rng.choice([2, 12]))
    ranks = {bytes([b]): b for b in range(256)}
    letters = "ab" if seed % 2 else "abc"
    while len(ranks) < 256 + 30:
        data = "".join(rng.choices(letters, k=300)).encode()
        parts = bpe.Transducer(ranks).merge(data)[0]
        pairs = [a + b for a, b in zip(parts, parts[1:], strict=False) if len(a + b) < 12]
        ranks.setdefault(rng.choice(pairs), len(ranks))
    own, library = bpe.Transducer(ranks, max_states=rng.choice([5, 50, 5000])), tiktoken.Encoding("x", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert own.pieces([]) == []
    for n in [1, 2, 3, 9, 30, 64, 65, 200]:
        texts = ["".join(rng.choices(letters, k=rng.randrange(1, n + 1))) for _ in range(60)]
        assert own.pieces([t.encode() for t in texts]) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_a_byte_without_a_token_is_an_error():
    own = bpe.Transducer({b"a": 0, b"b": 1, b"ab": 2})
    assert own.pieces([b"aab"]) == [np.array([0, 2], "<u4").tobytes()]
    for piece in [b"cab", b"acb", b"abc"]:
        with pytest.raises(ValueError):
            own.pieces([b"abab", piece])


def test_rare_words_are_not_followed_one_by_one(monkeypatch):
    calls = 0
    follow = bpe.Transducer._follow

    def counted(*args):
        nonlocal calls
        calls += 1
        return follow(*args)

    monkeypatch.setattr(bpe.Transducer, "_follow", counted)
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("aeinorstqxé", k=8)) for _ in range(4000))
    assert bpe.Encoder(RANKS, bpe.default_pattern()).encode(text) == ids_of(text)
    assert calls < 1000


def test_texts_together_are_as_alone(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_KNOWN", 100)
    own = bpe.Encoder(RANKS, bpe.default_pattern())
    texts = ["", " ", "a", "a ", " a", "\n\n", "\x85\n\na", " \xa0", " \xa0 \n\nabc", "\n\n\nabc \u3000", *PIECES, *(some_text(i, 8) for i in range(300)), "", "xy" * 700, ""]
    random.Random(3).shuffle(texts)
    wanted = [ids_of(t) for t in texts]
    for kind in (pa.string(), pa.large_string()):
        for group in (1, 50, 1000, 1 << 20):
            monkeypatch.setattr(bpe, "GROUP", group)
            assert own.encode_all(pa.array(texts, kind)) == wanted
        assert own.encode_all(pa.array(texts, kind).slice(7, 100)) == wanted[7:107]
    assert own.encode_all(pa.array([], pa.string())) == [] and own.encode_all(pa.array(["", None])) == [b"", b""]


def test_a_pattern_may_leave_something_out():
    pattern = r"\p{L}+|\s+(?!\S)|\s+"
    own, merge = bpe.Encoder(RANKS, pattern), bpe.Transducer(RANKS)
    texts = ["one two-three 4 five", "4 -", "six\xa07 eight", "7", " nine. ten"]
    for text, got in zip(texts, own.encode_all(pa.array(texts)), strict=True):
        ids = [i for p in regex.findall(pattern, text) for i in merge.piece(p.encode())]
        assert got == np.array(ids, "<u4").tobytes()


def test_ids_are_emitted_as_soon_as_they_are_sure():
    own = bpe.Transducer(RANKS)
    read = 0

    def watched(data):
        nonlocal read
        for read, byte in enumerate(data, 1):
            yield byte

    data = ("nevertheless" * 500).encode()
    given = 0
    for i in own.emit(watched(data)):
        given += len(own.tokens[i])
        assert read - given <= 3 * max(map(len, RANKS)) + bpe.EMIT_EVERY
    assert given == len(data)


def test_cutting_a_long_text_does_not_change_its_ids(monkeypatch):
    text = some_text(5, 3000)
    assert "".join(bpe.slices(text, 10)) == text and len(list(bpe.slices(text, 10))) > 20
    monkeypatch.setattr(bpe, "slices", lambda t, cut=bpe.slices: cut(t, 10))
    assert bpe.encoder(bpe.default_path(), bpe.default_pattern()).encode(text) == ids_of(text)


def test_state_machine_knows_utf8():
    for seed in range(300):
        rng = random.Random(seed)
        data = bytes(rng.choice([*"aé日🙂".encode(), rng.randrange(256)]) for _ in range(rng.randrange(12)))
        stream = bpe.StreamDecoder(bpe.tables(bpe.default_path()))
        ids = bpe.Transducer(RANKS).piece(data) if data else []
        parts = [stream.feed([i]) for i in ids] + [stream.finish()]
        assert b"".join(parts) == data
        # Each part on its own gives what the whole does.
        assert "".join(p.decode("utf-8", "replace") for p in parts) == data.decode("utf-8", "replace")
        # Nothing is held back but a character that may still go on.
        assert len(parts[-1]) < 4


def test_streamed_characters_come_whole():
    ids = LIBRARY.encode_ordinary("日本語🙂 été " * 20)
    stream = bpe.StreamDecoder(bpe.tables(bpe.default_path()))
    parts = [stream.feed([i]).decode() for i in ids]
    assert "".join(parts) == "日本語🙂 été " * 20 and stream.finish() == b""


def test_corner_cases_and_clashing_columns(spark):
    names = ["ids", "_text", "decoded", "_given", "n_tokens", "length"]
    rows = [(1, None), (1, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "word " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(7).alias(n) for n in names))
    encoded, column = bpe.encode(docs)
    assert encoded.columns == [*docs.columns, column]
    back, data = bpe.decode(encoded.drop("text"), column, as_text=True)
    got = back.collect()
    assert sorted((r["doc_id"] or 0, len(r[data])) for r in got) == sorted((k or 0, len(t or "")) for k, t in rows)
    assert all(r[n] == 7 for r in got for n in names)
    assert bpe.digests(docs.limit(0), ["doc_id"]).count() == 0


def test_query_over_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_bpe"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids, found = ids_of(row["text"] or ""), got[row["doc_id"]]
        assert found["n_tokens"] == len(ids) // 4
        assert found["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert found["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
