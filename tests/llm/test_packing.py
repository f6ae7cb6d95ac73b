import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from forgelake.llm import packing, token_files
from forgelake.llm.tokens import default_path, encoder, forget

WORDS = "The quick brown fox, it's 12 jumps! É́a ß — naïve".split()


def ids_of(text):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(default_path()).encode(text, add_special_tokens=False)
    return np.array(found.ids, "<u4")


def some_texts(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 10, 60]))) for _ in range(n)]


@pytest.mark.parametrize(
    "text", ["", " ", "a b", "it's a\nline\t\x1c x", "a<|endoftext|>b <|im_end|> <|startoftext|>", "É́ ΑΣ Σ", "x" * 5000]
)
def test_cached_words_give_the_ids_of_the_whole_text(text):
    assert encoder().encode([text, text])[1] == ids_of(text).tobytes()


def test_tree_takes_the_first_bin_with_room():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 33, rng.integers(1, 40))
        bins, offsets = packing.first_fit_decreasing(lengths, 32)
        free, used = [], np.zeros(len(lengths), int)
        for i in np.argsort(-lengths, kind="stable"):
            at = next((b for b, room in enumerate(free) if room >= lengths[i]), len(free))
            if at == len(free):
                free.append(32)
            assert (bins[i], offsets[i]) == (at, 32 - free[at])
            free[at] -= lengths[i]
        assert used.sum() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 12, 4095, 3000])
def test_powers_of_two_cover_the_total(total):
    starts = [*packing.powers_of_two(total), total]
    sizes = np.diff(starts)
    assert starts[0] == 0 and sizes.sum() == total and all(s & (s - 1) == 0 for s in sizes)


def assert_packed(rows, texts, length):
    """Every id lies in one piece of its row, every sequence is gapless and short enough."""
    seen = {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
    for key, pieces in seen.items():
        want = np.append(ids_of(texts[key] or ""), 2).astype("<u4")
        copies = sum(p["start"] == 0 for p in pieces)
        assert sum(p["length"] for p in pieces) == copies * len(want)
        for p in pieces:
            part = want[p["start"] : p["start"] + p["length"]]
            assert (p["doc_tokens"], p["ids_crc32"]) == (len(want), zlib.crc32(part.tobytes()))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length and all(p["sequence_tokens"] == at for p in pieces)
        assert pieces[0]["sequence_length"] == (at if at & (at - 1) == 0 else length)


def test_pack_places_every_id_once(documents):
    texts = dict(enumerate(some_texts(120)))
    texts[500], texts[501], texts[502] = None, "", "word " * 700
    docs = documents(list(texts.items()), "'x' AS group").unionByName(documents([(502, texts[502])], "'y' AS group"))
    rows = packing.digests(packing.pack(docs, sequence_length=64, group_rows=16)).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert_packed(rows, texts, 64)
    whole = {r["sequence_id"]: r["sequence_length"] for r in rows}
    assert sum(r["length"] for r in rows) / sum(whole.values()) > 0.9


def test_pack_of_an_empty_table_and_null_ids(documents):
    assert packing.pack(documents([])).count() == 0
    rows = packing.pack(documents([(None, "a b"), (None, "a b")])).collect()
    # Two rows of the same ids; a piece may be cut where its sequence is.
    assert {r["doc_id"] for r in rows} == {None}
    want = np.append(ids_of("a b"), 2).astype("<u4")
    assert sum(r["length"] for r in rows) == 2 * len(want) and sum(r["start"] == 0 for r in rows) == 2
    assert all(bytes(r["ids"]) == want[r["start"] : r["start"] + r["length"]].tobytes() for r in rows)


@pytest.mark.parametrize("end_id, width", [(2, 2), (70_000, 4)])
def test_ids_move_as_short_as_the_vocabulary_allows_and_come_back_in_32_bits(documents, end_id, width):
    texts = dict(enumerate(some_texts(30, 2)))
    docs = documents(list(texts.items()))
    cut = packing.cut_documents(docs.selectExpr("*", "doc_id % 2 AS _group"), 16, end_id, None).collect()
    assert all(len(r["ids"]) == width * r["length"] for r in cut)
    assert sum(r["length"] for r in cut) == sum(len(ids_of(t)) + 1 for t in texts.values())
    found = {}
    for r in sorted(packing.pack(docs, sequence_length=16, end_id=end_id).collect(), key=lambda r: r["start"]):
        found[r["doc_id"]] = found.get(r["doc_id"], b"") + bytes(r["ids"])
    assert found == {k: np.append(ids_of(t), end_id).astype("<u4").tobytes() for k, t in texts.items()}


def test_long_texts_leave_a_worker_in_batches_of_bounded_size(documents, monkeypatch):
    seen, text = [], "word " * 300
    monkeypatch.setattr(packing, "BATCH_TOKENS", 64)
    monkeypatch.setattr(packing, "map_batches", lambda df, function, schema: seen.append(function))
    packing.cut_documents(documents([]).selectExpr("*", "0L AS _group"), 16, 2, None)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "_group": [0, 0], "text": [text, ""]})
    parts = list(seen[0]([batch]))
    assert len(parts) > 1 and all(len(p["doc_id"]) <= 4 for p in parts)
    joined = b"".join(x for p in parts for x in p["ids"].to_pylist())
    assert joined == np.array([*ids_of(text), 2, 2], "<u2").tobytes()


def test_few_rows_of_long_texts_are_read_at_once(documents):
    spark = documents([]).sparkSession
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    packing.pack(documents([(1, "a")]))
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1024


def test_encoders_are_forgotten_and_made_again():
    want = encoder().encode(["a b"])
    assert forget() and not forget()
    assert encoder().encode(["a b"]) == want


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(1000))])
def test_values_come_back(values):
    values = np.array(values, np.uint32)
    control, data = token_files.encode_values(values)
    assert len(control) == -(-len(values) // 4)
    assert (token_files.decode_values(control, data, len(values)) == values).all()


def test_token_files_round_trip(documents, tmp_path):
    texts = {i * 3 - 30: t for i, t in enumerate(some_texts(60, 1))}
    texts[1000], texts[1001] = None, "word " * 300
    docs = documents(list(texts.items()), "'x' AS shard").repartition(5)
    token_files.write_tokens(docs, str(tmp_path / "set"), block_tokens=50)
    rows = token_files.read_tokens(docs.sparkSession, str(tmp_path / "set")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(texts)
    at = 0
    for r in rows:
        want = np.append(ids_of(texts[r["doc_id"]] or ""), 1).astype("<u4")
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(want), want.tobytes())
        at += len(want)


def test_token_files_of_nulls_copies_and_nothing(documents, tmp_path):
    docs = documents([(None, "b"), (7, "a"), (7, "a"), (7, "c d")])
    token_files.write_tokens(docs, str(tmp_path / "a"))
    rows = token_files.read_tokens(docs.sparkSession, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 7, 7, 7]
    assert sum(r["n_tokens"] for r in rows) == rows[-1]["start"] + rows[-1]["n_tokens"]
    token_files.write_tokens(documents([]), str(tmp_path / "b"))
    assert token_files.read_tokens(docs.sparkSession, str(tmp_path / "b")).count() == 0
