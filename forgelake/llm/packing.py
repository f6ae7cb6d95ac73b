"""Packing of documents into sequences of fixed length (operator 1).

Documents are tokenized and cut into pieces of at most one sequence. Pieces are dealt at random into
groups of a bounded expected size, and each group is packed on its own by first-fit decreasing: pieces
in falling length, each into the first open sequence that has room. A tournament tree over the free
room of the sequences finds that one in logarithmic time.

What first-fit decreasing leaves poorly filled is cut once more, into sequences whose lengths are
powers of two: those need no padding.

Defined results: a NULL or empty text is the end id alone. Rows that repeat, also with one doc_id, are
packed once per row. NULL ids stay NULL. An empty table gives no pieces. Columns other than id and
text are not read. A text of any length is cut; no task holds more than one text and one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgelake.llm.common import give_back, map_batches, prepare, row_salt, text_or_empty, type_of
from forgelake.llm.token_files import from_binary, to_binary
from forgelake.llm.tokens import encoder, forget

SEQUENCE_LENGTH = 4096
END_ID = 2
# Documents per group, on average.
GROUP_ROWS = 1024
# A sequence filled less than this is cut into powers of two.
MIN_FILL = 0.98
# Words whose ids a worker remembers; packing takes its memory on top.
PACKED_WORDS = 300_000
# Tokens in a batch that leaves a worker, at most, if a piece has no more.
BATCH_TOKENS = 1 << 20


class TournamentTree:
    """Free room of bins that are opened one after another; finds the first with enough room."""

    def __init__(self, leaves: int, room: int):
        self.size = 1 << max(0, (leaves - 1).bit_length())
        self.best = [room] * (2 * self.size)

    def take(self, amount: int) -> tuple[int, int]:
        """Take ``amount`` from the first bin that has it; the bin and its room before."""
        best, node = self.best, 1
        while node < self.size:
            node *= 2
            if best[node] < amount:
                node += 1
        room, found = best[node], node - self.size
        best[node] = room - amount
        while node > 1:
            node //= 2
            highest = max(best[2 * node], best[2 * node + 1])
            if best[node] == highest:
                break
            best[node] = highest
        return found, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in the bin of each piece; among equal lengths the earlier piece goes first."""
    order = np.argsort(-lengths, kind="stable")
    tree = TournamentTree(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, amount in zip(order.tolist(), lengths[order].tolist(), strict=True):
        bins[i], room = tree.take(amount)
        offsets[i] = capacity - room
    return bins, offsets


def powers_of_two(total: int) -> list[int]:
    """Where a run of ``total`` tokens is cut so that every part is a power of two; starts of the parts."""
    starts, at = [], 0
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            starts.append(at)
            at += 1 << bit
    return starts


def pack_group(lengths: np.ndarray, starts: np.ndarray, capacity: int, min_fill: float) -> dict[str, np.ndarray]:
    """Pack the pieces of one group, and cut them where a bin is cut. One row per piece that is left: ``row`` tells which
    piece it is of, ``skip`` how many of that piece's tokens come before it."""
    bins, offsets = first_fit_decreasing(lengths, capacity)
    totals = np.bincount(bins, lengths).astype(np.int64)
    cut = {b: powers_of_two(int(totals[b])) for b in np.flatnonzero(totals < min_fill * capacity).tolist()}
    sizes, first = [len(cut.get(b, [0])) for b in range(len(totals))], 0
    new_bin = []
    for n in sizes:
        new_bin.append(first)
        first += n
    out = []
    for i, (b, offset, length, start) in enumerate(
        zip(bins.tolist(), offsets.tolist(), lengths.tolist(), starts.tolist(), strict=True)
    ):
        if b not in cut:
            out.append((i, start, length, 0, new_bin[b], offset, int(totals[b])))
            continue
        parts = [*cut[b], int(totals[b])]
        for k in range(len(parts) - 1):
            low, high = max(offset, parts[k]), min(offset + length, parts[k + 1])
            if low < high:
                skip, size = low - offset, parts[k + 1] - parts[k]
                out.append((i, start + skip, high - low, skip, new_bin[b] + k, low - parts[k], size))
    names = ("row", "start", "length", "skip", "bin", "offset", "bin_tokens")
    return {n: np.array(x, np.int64) for n, x in zip(names, zip(*out, strict=True), strict=True)}


def cut_documents(
    docs: DataFrame,
    capacity: int,
    end_id: int,
    tokenizer: str | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_words: int = PACKED_WORDS,
) -> DataFrame:
    """One row per piece: id, its start in the document, its ids as little-endian unsigned integers: 16 bit if all ids
    of the vocabulary fit, else 32."""
    step = max(1, BATCH_TOKENS // capacity)

    def cut(batches) -> Iterator[dict[str, list]]:
        to_ids = encoder(tokenizer, max_words)
        kind = np.dtype("<u2" if max(to_ids.size - 1, end_id) <= 0xFFFF else "<u4")
        for batch in batches:
            found, lengths = to_ids.flat(batch.column(2).cast(pa.string()))
            flat, totals = np.insert(found.astype(kind), np.cumsum(lengths), end_id), lengths + 1
            pieces = -(-totals // capacity)
            rows = np.repeat(np.arange(len(totals)), pieces)
            starts = (np.arange(len(rows)) - (np.cumsum(pieces) - pieces)[rows]) * capacity
            sizes = np.minimum(capacity, totals[rows] - starts)
            ends = np.cumsum(sizes)
            # The pieces of a long text go in parts, each of bounded size.
            for low in range(0, len(rows), step):
                part = slice(low, low + step)
                begin = ends[low] - sizes[low]
                yield {
                    "doc_id": batch.column(0).take(pa.array(rows[part])).to_pylist(),
                    "group": batch.column(1).take(pa.array(rows[part])),
                    "start": pa.array(starts[part], pa.int64()),
                    "length": pa.array(sizes[part], pa.int64()),
                    "doc_tokens": pa.array(totals[rows[part]], pa.int64()),
                    "ids": to_binary(flat[begin : ends[part][-1]], sizes[part]),
                }

    schema = T.StructType(
        [
            T.StructField("doc_id", type_of(docs, id_col)),
            *(T.StructField(n, T.LongType()) for n in ("group", "start", "length", "doc_tokens")),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return map_batches(docs.select(id_col, "_group", text_or_empty(text_col)), cut, schema)


def pack(
    docs: DataFrame,
    *,
    sequence_length: int = SEQUENCE_LENGTH,
    end_id: int = END_ID,
    group_rows: int = GROUP_ROWS,
    min_fill: float = MIN_FILL,
    tokenizer: str | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_words: int = PACKED_WORDS,
) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset,
    sequence_tokens (tokens in the sequence) and sequence_length (with padding). A worker remembers the ids of
    ``max_words`` words."""
    prepare(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_rows))
    # The row's place in the scan decides its group, so that copies of one id do not meet in one group.
    dealt = docs.select(id_col, text_col).withColumn("_group", row_salt(groups, seed))
    pieces = cut_documents(dealt, sequence_length, end_id, tokenizer, id_col, text_col, max_words)
    key = type_of(docs, id_col).simpleString()
    schema = (
        f"doc_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
        "sequence_tokens long, sequence_length long"
    )

    def pack_one(key: tuple[pa.Scalar, ...], arrow: pa.Table) -> pa.Table:
        # The words known since the documents were cut are of no use here.
        if forget():
            give_back()
        lengths, starts = (arrow[n].to_numpy() for n in ("length", "start"))
        kind = np.dtype(f"<u{len(arrow['ids'][0].as_py()) // int(lengths[0])}")
        ids = []
        for chunk in arrow["ids"].chunks:
            flat, sizes = from_binary(chunk.cast(pa.binary()), kind)
            ids += np.split(flat, np.cumsum(sizes)[:-1])[: len(sizes)]
        # A fixed order, whatever order the shuffle delivers: first-fit then repeats when a task does.
        crc = np.array([zlib.crc32(x.astype("<u4")) for x in ids], np.int64)
        order = np.lexsort((crc, starts, -lengths))
        packed = pack_group(lengths[order], starts[order], sequence_length, min_fill)
        rows, sizes = order[packed["row"]], packed["length"]
        places = list(zip(rows.tolist(), packed["skip"].tolist(), sizes.tolist(), strict=True))
        step = max(1, BATCH_TOKENS // sequence_length)
        parts = []
        for low in range(0, len(places), step):
            some = np.concatenate([ids[i][skip : skip + n] for i, skip, n in places[low : low + step]])
            parts.append(to_binary(some.astype("<u4"), sizes[low : low + step]))
        tokens = packed["bin_tokens"]
        whole = (tokens & (tokens - 1)) == 0
        return pa.table(
            {
                "doc_id": arrow["doc_id"].take(pa.array(rows)),
                "start": packed["start"],
                "length": sizes,
                "ids": pa.chunked_array(parts, pa.binary()),
                "doc_tokens": arrow["doc_tokens"].take(pa.array(rows)),
                "sequence_id": (key[0].as_py() << 32) + packed["bin"],
                "offset": packed["offset"],
                "sequence_tokens": tokens,
                "sequence_length": np.where(whole, tokens, sequence_length).astype(np.int64),
            }
        )

    return pieces.groupBy("group").applyInArrow(pack_one, schema)


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
