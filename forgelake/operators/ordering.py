"""Order-dependent columns per key that stay spread out when one key is huge.

A plain window puts every row of a key into one task. Here a key that holds more than one chunk of
rows is cut along its own order into chunks. The window then runs per (key, chunk), and what has to
cross a chunk border travels in a table with one row per chunk. The result is exactly that of the
plain window, which is what runs when no key is that large.

How far the small tables can grow: a key counts as hot only above ``total / MAX_CHUNKS`` rows, so
there are at most ``MAX_CHUNKS`` hot keys, and one row in ``total / MAX_CHUNKS`` becomes a cut, so
there are about ``MAX_CHUNKS`` cuts over all keys together. Both are therefore broadcast.

The price is one count of the input when the plan is made, and one count per key if the input is
larger than a chunk; both read the key columns only.

Order columns must be unique within a key; their values compare with nulls first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgelake.session import materialize, scratch_path

# Rows a chunk holds at least; the session setting of this name overrides the default.
CHUNK_ROWS_KEY = "forgelake.chunk.rows"
CHUNK_ROWS = 2_000_000
MAX_CHUNKS = 16384
# Rows a single task may sort for a top-n or a shallow page.
TOP_ROWS = 100_000

_STRIDE = 64


def _hot_cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int | None) -> DataFrame | None:
    """Sorted cut points per hot key, or None when every key fits into a chunk."""
    chunk_rows = chunk_rows or int(df.sparkSession.conf.get(CHUNK_ROWS_KEY, str(CHUNK_ROWS)))
    total = df.count()
    if total <= chunk_rows:
        return None
    size = max(chunk_rows, -(-total // MAX_CHUNKS))
    hot = materialize(
        df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > size).select(*keys), "hot-keys"
    )
    if hot.isEmpty():
        return None
    position = F.struct(*order)
    marks = df.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(size)) == 0).join(
        F.broadcast(hot), list(keys), "left_semi"
    )
    cuts = marks.groupBy(*keys).agg(F.array_sort(F.collect_set(position)).alias("_cuts"))
    # Every stride-th cut, so that a row compares with two short lists instead of one long one.
    coarse = F.filter("_cuts", lambda _, i: i % _STRIDE == 0)
    return materialize(cuts.withColumn("_coarse", coarse), "cuts")


def _with_chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: DataFrame) -> DataFrame:
    """Add ``_chunk``: how many cuts of its key a row has passed; NULL for keys that are not hot."""
    position = F.struct(*order)
    passed = F.size(F.filter("_coarse", lambda c: c <= position))
    start = F.greatest(passed - 1, F.lit(0)) * _STRIDE
    near = F.slice("_cuts", start + 1, _STRIDE)
    chunk = start + F.size(F.filter(near, lambda c: c <= position))
    return (
        df.join(F.broadcast(cuts), list(keys), "left")
        .withColumn("_chunk", F.when(F.col("_cuts").isNotNull(), chunk))
        .drop("_cuts", "_coarse")
    )


def _per_chunk(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    return rows.filter(F.col("_chunk").isNotNull()).groupBy(*keys, "_chunk").agg(value.alias("_part"))


def _carry(rows: DataFrame, keys: Sequence[str], parts: DataFrame, carried: Column, name: str) -> DataFrame:
    """Join one carried value per chunk onto the rows of that chunk."""
    return rows.join(
        F.broadcast(parts.select(*keys, "_chunk", carried.alias(name))), [*keys, "_chunk"], "left"
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    following: bool = False,
    sized_by: DataFrame | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add the value of the preceding (or following) row of the same key, NULL at the end.

    Hot keys and cuts are taken from ``sized_by``, by default the table itself. A part of the table
    will do when the rest adds few rows per key.
    """
    step = F.lead if following else F.lag
    cuts = _hot_cuts(df if sized_by is None else sized_by, keys, order, chunk_rows)
    if cuts is None:
        return df.withColumn(name, step(value).over(Window.partitionBy(*keys).orderBy(*order)))
    rows = _with_chunk(df, keys, order, cuts)
    edge = F.min_by if following else F.max_by
    # Wrapped, so that a NULL value of a neighbour is told apart from having no neighbour.
    parts = _per_chunk(rows, keys, edge(F.struct(value.alias("v")), F.struct(*order)))
    near = step("_part").over(Window.partitionBy(*keys).orderBy("_chunk"))
    within = step(F.struct(value.alias("v"))).over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    return (
        _carry(rows.withColumn("_near", within), keys, parts, near, "_far")
        .withColumn(name, F.coalesce("_near", "_far")["v"])
        .drop("_chunk", "_near", "_far")
    )


def with_next(df, keys, order, value, name, *, chunk_rows: int | None = None) -> DataFrame:
    """Add the value of the following row of the same key."""
    return with_previous(df, keys, order, value, name, following=True, chunk_rows=chunk_rows)


def with_sum_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the same key, 0 at the first."""
    before = (Window.unboundedPreceding, -1)
    cuts = _hot_cuts(df, keys, order, chunk_rows)
    zero = F.lit(0).cast("bigint")
    if cuts is None:
        running = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before))
        return df.withColumn(name, F.coalesce(running, zero))
    rows = _with_chunk(df, keys, order, cuts)
    parts = _per_chunk(rows, keys, F.sum(value))
    far = F.sum("_part").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*before))
    near = F.sum(value).over(Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(*before))
    return (
        _carry(rows.withColumn("_near", near), keys, parts, far, "_far")
        .withColumn(name, F.coalesce("_near", zero) + F.coalesce("_far", zero))
        .drop("_chunk", "_near", "_far")
    )


def with_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *, chunk_rows: int | None = None
) -> DataFrame:
    """Add the 1-based position of a row within its key."""
    counted = with_sum_before(df, keys, order, F.lit(1).cast("bigint"), name, chunk_rows=chunk_rows)
    return counted.withColumn(name, F.col(name) + 1)


def with_position(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add the 1-based position of a row in the order of the whole table.

    The table is sorted into the shared folder by range, one file per range. A row's position is
    its row number in its file plus the sizes of the files before it; there is one size per file.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sorted")
    df.orderBy(*order).write.option("maxRecordsPerFile", 0).parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(
        "*",
        F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n")).collect()
    starts, before = [], 0
    for size in sorted(sizes):
        starts.append((size["_file"], before))
        before += size["_n"]
    offsets = spark.createDataFrame(starts, "_file int, _before bigint")
    return (
        rows.join(F.broadcast(offsets), "_file")
        .withColumn(name, F.col("_before") + F.col("_row") + 1)
        .drop("_file", "_row", "_before")
    )


def rows_between(
    df: DataFrame, order: Sequence[str], offset: int, limit: int, *, top_rows: int = TOP_ROWS
) -> DataFrame:
    """Rows ``offset + 1 .. offset + limit`` of the table in the given order.

    Spark's own sort-and-limit ends in one task that holds ``offset + limit`` rows, so it serves
    only up to ``top_rows``; beyond, rows are kept by position in a distributed sort.
    """
    if offset + limit <= top_rows:
        return df.orderBy(*order).offset(offset).limit(limit)
    placed = with_position(df, order, "_position")
    page = placed.filter(F.col("_position").between(offset + 1, offset + limit))
    return page.orderBy("_position").drop("_position")
