"""Repeated runs of lines by a suffix array over line ids (operator 9).

All documents together are one long sequence of lines with a border after each document. A suffix starts
at every line. Lines that occur once end every repeat, so only the others take part.

* **Prefix doubling.** Rank 0 of a suffix is its first line's place among all repeated lines in sorted
  order. Rank h + 1 is the place of the pair (rank h here, rank h 2^h lines further on), so it orders the
  suffixes by their first 2^(h+1) lines. Pairs that occur once drop out: nothing longer repeats there. Each
  round is a join, an aggregate and a distributed sort of the distinct pairs. Rounds end when the
  longest run that can decide a deletion is covered.
* **Longest-common-prefix intervals.** Suffixes that share their first n lines are neighbours in the
  suffix array: an interval with a common prefix of at least n. It is named by two ranks, those of the
  first and of the last 2^h of the n lines, where 2^h <= n < 2^(h+1). Its least position is the first
  occurrence; all others are later copies.
* A run counts if it has at least ``MIN_WORDS`` words. Testing, for each line, the shortest run with so
  many words that starts there, and the shortest that ends there, is enough: every longer repeated run is
  the union of such runs. The union of all later copies is deleted, so maximal repeated runs go whole,
  except for their first occurrence.

The order of documents is that of their ids, NULL last, then that of their rows. Copies may overlap: of
n equal lines in a row, the first stays.

Defined results: a NULL text stays NULL. A text all of whose lines are deleted is empty. Rows that
repeat are later copies of the first. Lines are compared as they are; a document of one line without a
line end is one line. An empty table gives an empty result. A document with very many lines is one
array row, a line in very many documents is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelake.llm.common import free_name, map_batches, prepare
from forgelake.operators.ordering import with_position
from forgelake.session import materialize

MIN_WORDS = 10


def words_in(line: Column) -> Column:
    """Runs of characters that are no white space; counts blanks where single blanks are all there is."""
    trimmed = F.trim(line)
    plain = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + (trimmed != "").cast("int")
    odd = F.contains(trimmed, F.lit("  ")) | (F.translate(line, "\t\x0b\x0c\r\x1c\x1d\x1e\x1f", "") != line)
    return F.when(odd, F.regexp_count(line, F.lit(r"[^ \t\x0B\f\r\x1c-\x1f]+"))).otherwise(plain)


def repeated_lines(held: DataFrame, text_col: str) -> DataFrame:
    """row, line, words and rank of every line that occurs more than once; ``place`` orders positions."""
    lines = held.select("_row", "_place", F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line", "_line"))
    named = lines.select("_row", "_place", "line", F.unhex(F.md5("_line")).alias("id"), words_in(F.col("_line")).alias("words"))
    counts = named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    ranked = with_position(counts, ["id"], "rank")
    return materialize(named.join(ranked, "id").drop("id"), "repeated-lines")


def candidate_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """row, start and n of the shortest runs of repeated lines with enough words from and up to each line."""

    def find(batches) -> Iterator[dict[str, list]]:
        for batch in batches:
            rows, cells = batch.column(0).to_pylist(), batch.column(1)
            offsets = cells.offsets.to_numpy()
            line, words = (cells.values.field(i).to_numpy() for i in (0, 1))
            for k, row in enumerate(rows):
                at, size = line[offsets[k] : offsets[k + 1]], words[offsets[k] : offsets[k + 1]]
                # Stretches of consecutive lines; runs do not leave them.
                stretch = np.cumsum(np.append(0, np.diff(at) != 1))
                total = np.append(0, np.cumsum(size))
                ends = np.searchsorted(total, total[:-1] + min_words)
                fits = ends <= len(at)
                first = np.flatnonzero(fits)
                forward = np.stack([first, ends[fits] - 1], 1)
                begins = np.searchsorted(total, total[1:] - min_words, side="right") - 1
                back = np.flatnonzero(begins >= 0)
                both = np.concatenate([forward, np.stack([begins[back], back], 1)])
                both = np.unique(both[stretch[both[:, 0]] == stretch[both[:, 1]]], axis=0)
                yield {
                    "_row": [row] * len(both),
                    "start": pa.array(at[both[:, 0]].astype(np.int64)),
                    "n": pa.array((both[:, 1] - both[:, 0] + 1).astype(np.int64)),
                }

    cells = F.array_sort(F.collect_list(F.struct("line", F.col("words").cast("int").alias("words"))))
    grouped = lines.groupBy("_row").agg(cells.alias("cells"))
    return materialize(map_batches(grouped, find, "_row bigint, start bigint, n bigint"), "candidate-runs")


def prefix_doubling(lines: DataFrame, longest: int) -> list[DataFrame]:
    """Ranks of the suffixes by their first 1, 2, 4, ... lines, up to the last power within ``longest``.

    Each is ``_row, line, rank``; suffixes whose prefix occurs once, or crosses a border, are left out.
    """
    levels = [lines.select("_row", "line", "rank")]
    step = 1
    while 2 * step <= longest:
        last = levels[-1]
        further = last.select("_row", (F.col("line") - step).alias("line"), F.col("rank").alias("next"))
        pairs = last.join(further, ["_row", "line"])
        repeated = pairs.groupBy("rank", "next").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        numbered = with_position(repeated, ["rank", "next"], "_rank")
        ranked = pairs.join(numbered, ["rank", "next"]).select("_row", "line", F.col("_rank").alias("rank"))
        levels.append(materialize(ranked, f"suffix-ranks-{2 * step}"))
        step *= 2
    return levels


def later_copies(lines: DataFrame, runs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The runs that are no first occurrence of their interval."""
    out = None
    places = lines.select("_row", "line", "_place")
    for h, ranks in enumerate(levels):
        mine = runs.filter((F.col("n") >= 1 << h) & (F.col("n") < 1 << (h + 1)))
        first = ranks.join(places, ["_row", "line"]).select("_row", F.col("line").alias("start"), F.col("rank").alias("first"), "_place")
        last = ranks.select("_row", F.col("line").alias("_at"), F.col("rank").alias("last"))
        named = mine.join(first, ["_row", "start"]).withColumn("_at", F.col("start") + F.col("n") - (1 << h))
        named = named.join(last, ["_row", "_at"]).withColumn("position", F.struct("_place", "_row", "start"))
        found = named.select(F.lit(h).alias("level"), "n", "first", "last", "_row", "start", "position")
        out = found if out is None else out.unionByName(found)
    members = materialize(out, "intervals")
    key = ["level", "n", "first", "last"]
    firsts = members.groupBy(*key).agg(F.min("position").alias("_least"), F.count("*").alias("_n")).filter("_n > 1")
    joined = members.join(firsts, key)
    return joined.filter(F.col("position") > F.col("_least")).select("_row", "start", "n")


def merged(runs: DataFrame) -> DataFrame:
    """Per document, the union of its runs as ``deleted``: array of start and n, ascending and apart."""
    span = "array<struct<start:bigint,n:bigint>>"
    gathered = runs.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("_runs"))

    def step(state: Column, run: Column) -> Column:
        end = run["start"] + run["n"]
        apart = run["start"] > state["end"]
        closed = F.when(
            apart & (state["end"] > state["start"]),
            F.concat(state["done"], F.array(F.struct(state["start"].alias("start"), (state["end"] - state["start"]).alias("n")))),
        ).otherwise(state["done"])
        return F.struct(
            F.when(apart, run["start"]).otherwise(state["start"]).alias("start"),
            F.when(apart, end).otherwise(F.greatest(state["end"], end)).alias("end"),
            closed.alias("done"),
        )

    zero = F.lit(-1).cast("bigint")
    state = F.aggregate(
        "_runs", F.struct(zero.alias("start"), zero.alias("end"), F.array().cast(span).alias("done")), step
    )
    last = F.struct(F.col("_s.start").alias("start"), (F.col("_s.end") - F.col("_s.start")).alias("n"))
    return gathered.select("_row", state.alias("_s")).select("_row", F.concat("_s.done", F.array(last)).alias("deleted"))


def without_runs(text: Column, deleted: Column) -> Column:
    """The text without the deleted lines: the slices between them, joined."""
    lines = F.split(text, "\n")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(deleted, lambda d: d["start"] + d["n"]))
    ends = F.concat(F.transform(deleted, lambda d: d["start"]), F.array(F.size(lines).cast("bigint")))
    kept = F.transform(
        F.arrays_zip(begins.alias("b"), ends.alias("e")),
        lambda s: F.slice(lines, (s["b"] + 1).cast("int"), F.greatest(s["e"] - s["b"], F.lit(0)).cast("int")),
    )
    return F.array_join(F.flatten(kept), "\n")


def deduplicate(
    docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs``, the text without later copies of repeated line runs, and ``_deleted`` (or, where a
    column is called so, the next free name): the deleted runs as an array of first line (from 0) and number of
    lines, NULL where there are none."""
    prepare(docs.sparkSession)
    out_col = free_name("_deleted", docs.columns)
    row = free_name("_row", [*docs.columns, out_col])
    # Written once, so that a row keeps its number whatever happens to the cluster.
    held = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    # Positions compare by id, NULL last, then by row.
    place = F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"))
    lines = repeated_lines(held.select(F.col(row).alias("_row"), place.alias("_place"), F.col(text_col).alias("text")), "text")
    runs = candidate_runs(lines, min_words)
    longest = runs.agg(F.max("n")).first()[0] or 0
    if longest:
        deleted = merged(later_copies(lines, runs, prefix_doubling(lines, longest)))
    else:
        deleted = runs.select("_row", F.array().cast("array<struct<start:bigint,n:bigint>>").alias("deleted")).limit(0)
    out = held.join(deleted.toDF(row, out_col), row, "left").drop(row)
    text = F.when(F.col(out_col).isNull(), F.col(text_col)).otherwise(without_runs(F.col(text_col), F.col(out_col)))
    return out.withColumn(text_col, text)
