"""Token ids in files with a byte-aligned variable-length code (operator 4).

Ids are replaced by their rank in the corpus, the most frequent first, so that frequent ids take one
byte. A rank is stored in one to four bytes. The lengths stand apart from the bytes: a control byte
holds the lengths (less one) of four ranks, two bits each, the first in the lowest bits. Reading looks
up a control byte in a table of byte masks and spreads the data bytes over it with numpy.

A file set is a folder: ``ranks`` (rank, id) and ``blocks``. A block row holds whole documents in
ascending order of doc_id: ``shard``, ``block``, ``first`` (tokens of the shard before it),
``n_values``, ``doc_ids``, ``n_tokens`` (one entry per document), ``control`` and ``data``. Blocks are
rows of Parquet files: Spark commits them whole or not at all, and every store Spark reaches will do.

Defined results: a NULL or empty text is the end id alone. A NULL doc_id sorts first. Rows that share a
doc_id are ordered by a hash of their text. An empty table gives an empty set. Columns other than id
and text are not read. A document longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgelake.llm.common import map_batches, prepare, text_or_empty, type_of
from forgelake.llm.tokens import encoder
from forgelake.session import scratch_path

END_ID = 1
# Tokens after which a block is closed.
BLOCK_TOKENS = 1 << 16

# For each control byte, which of the four bytes of each of its four values are stored.
_MASKS = np.arange(4)[None, None, :] <= (np.arange(256)[:, None, None] >> np.array([0, 2, 4, 6])[None, :, None] & 3)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    stored = _MASKS[control].reshape(-1, 4)[: len(values)]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[stored].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    stored = _MASKS[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[stored] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def to_binary(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary value for each run of ``flat``, without a copy of its own."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * flat.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def from_binary(values: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binary values in a row, and how many each value has."""
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    ends = np.frombuffer(offsets, "<i4")[values.offset : values.offset + len(values) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]].view(kind), np.diff(ends) // kind.itemsize


def tokenize(
    docs: DataFrame, end_id: int, tokenizer: str | None, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, np.dtype]:
    """doc_id, a tie breaker and the ids of each row, with the end id, and the kind of number they are stored
    as: 16 bit if all ids of the vocabulary fit."""
    kind = np.dtype("<u2" if max(encoder(tokenizer).size - 1, end_id) <= 0xFFFF else "<u4")

    def run(batches) -> Iterator[dict[str, list]]:
        to_ids = encoder(tokenizer)
        for batch in batches:
            found, lengths = to_ids.flat(batch.column(2))
            flat = np.insert(found.astype(kind), np.cumsum(lengths), end_id)
            yield {"doc_id": batch.column(0), "tie": batch.column(1), "ids": to_binary(flat, lengths + 1)}

    schema = T.StructType(
        [
            T.StructField("doc_id", type_of(docs, id_col)),
            T.StructField("tie", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    text = text_or_empty(text_col)
    return map_batches(docs.select(F.col(id_col), F.xxhash64(text), text), run, schema), kind


def id_counts(tokens: DataFrame, kind: np.dtype) -> DataFrame:
    """How often each id occurs: counted per task first, one row per id and task at most."""

    def count(batches) -> Iterator[dict[str, list]]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(from_binary(batch.column(0), kind)[0], minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield {"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())}

    return map_batches(tokens.select("ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Encode ``docs`` into the file set ``path``."""
    spark = prepare(docs.sparkSession)
    staged = scratch_path(spark, "tokens")
    found, kind = tokenize(docs, end_id, tokenizer, id_col, text_col)
    found.write.option("compression", "zstd").parquet(staged)
    tokens = spark.read.schema(found.schema).parquet(staged)
    # One row per id of the vocabulary, whatever the corpus.
    counts = sorted(id_counts(tokens, kind).collect(), key=lambda r: (-r["n"], r["id"]))
    ids = [r["id"] for r in counts]
    spark.createDataFrame(list(enumerate(ids)), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, "<u4")
    rank_of[ids] = np.arange(len(ids))

    def encode(batches) -> Iterator[dict[str, list]]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        keys, counts, parts, size = [], [], [], 0

        def close():
            values = rank_of[np.concatenate(parts)]
            control, data = encode_values(values)
            return {
                "shard": [shard],
                "block": [block],
                "first": [first],
                "n_values": [len(values)],
                "doc_ids": [keys],
                "n_tokens": [counts],
                "control": [control],
                "data": [data],
            }

        for batch in batches:
            flat, lengths = from_binary(batch.column(1), kind)
            ids, ends, done = batch.column(0).to_pylist(), np.cumsum(lengths), 0
            while done < len(ids):
                before = int(ends[done - 1]) if done else 0
                # Up to the document that fills the block.
                stop = min(len(ids), int(np.searchsorted(ends, before + block_tokens - size)) + 1)
                after = int(ends[stop - 1])
                keys += ids[done:stop]
                counts += lengths[done:stop].tolist()
                parts.append(flat[before:after])
                size, done = size + after - before, stop
                if size >= block_tokens:
                    yield close()
                    keys, counts, parts, block, first, size = [], [], [], block + 1, first + size, 0
        if keys:
            yield close()

    key = type_of(docs, id_col).simpleString()
    schema = (
        f"shard long, block long, first long, n_values long, doc_ids array<{key}>, n_tokens array<long>, "
        "control binary, data binary"
    )
    # Shards follow the order of ids; the tie breaker also divides an id that many rows share.
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    map_batches(ranged, encode, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids of each document."""
    blocks = prepare(spark).read.parquet(f"{path}/blocks")
    # One row per shard, and one per id of the vocabulary.
    sizes = blocks.groupBy("shard").agg(F.sum("n_values").alias("n")).orderBy("shard").collect()
    starts, before = [], 0
    for row in sizes:
        starts.append((row["shard"], before))
        before += row["n"]
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in ranks], "<u4")
    offsets = spark.createDataFrame(starts, "shard long, before long")
    key = next(f.dataType.elementType for f in blocks.schema.fields if f.name == "doc_ids")

    def decode(batches) -> Iterator[dict[str, list]]:
        for batch in batches:
            for first, n, keys, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lengths = np.array(lengths, np.int64)
                yield {
                    "doc_id": keys,
                    "start": pa.array(first + np.cumsum(lengths) - lengths),
                    "n_tokens": pa.array(lengths),
                    "ids": to_binary(id_of[decode_values(control, data, n)], lengths),
                }

    schema = T.StructType(
        [
            T.StructField("doc_id", key),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    rows = blocks.join(F.broadcast(offsets), "shard").select(
        F.col("first") + F.col("before"), "n_values", "doc_ids", "n_tokens", "control", "data"
    )
    return map_batches(rows, decode, schema)
