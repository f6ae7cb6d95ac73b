"""Ordered columns against plain Python, with chunks so small that hot keys are cut."""

import random

import pytest
from pyspark.sql import functions as F

from forgelake.operators import ordering


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # One key holds a third of all rows; its order values collide in the leading column.
    keys = ["hot"] * 600 + [f"k{rng.randrange(90)}" for _ in range(1200)]
    out = [(k, rng.choice([None, *range(7)]), i, rng.choice([None, "x", "y", "z"]), rng.randrange(9)) for i, k in enumerate(keys)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k string, a int, b int, v string, w bigint").repartition(6)


def per_key(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    return groups


def found(df, name):
    return {r["b"]: r[name] for r in df.collect()}


@pytest.mark.parametrize("chunk_rows", [25, 10_000])
def test_columns_agree_with_python(table, rows, chunk_rows):
    order, groups = ["a", "b"], per_key(rows)
    prev = ordering.with_previous(table, ["k"], order, F.col("v"), "o", chunk_rows=chunk_rows)
    nxt = ordering.with_next(table, ["k"], order, F.col("v"), "o", chunk_rows=chunk_rows)
    idx = ordering.with_index(table, ["k"], order, "o", chunk_rows=chunk_rows)
    run = ordering.with_sum_before(table, ["k"], order, F.col("w"), "o", chunk_rows=chunk_rows)
    want = {"prev": {}, "next": {}, "idx": {}, "run": {}}
    for g in groups.values():
        total = 0
        for i, r in enumerate(g):
            want["prev"][r[2]] = g[i - 1][3] if i else None
            want["next"][r[2]] = g[i + 1][3] if i + 1 < len(g) else None
            want["idx"][r[2]] = i + 1
            want["run"][r[2]] = total
            total += r[4]
    assert found(prev, "o") == want["prev"]
    assert found(nxt, "o") == want["next"]
    assert found(idx, "o") == want["idx"]
    assert found(run, "o") == want["run"]
    assert set(prev.columns) == {"k", "a", "b", "v", "w", "o"}


def test_hot_key_is_cut_into_chunks(table):
    cuts = ordering._hot_cuts(table, ["k"], ["a", "b"], 25)
    chunks = ordering._with_chunk(table, ["k"], ["a", "b"], cuts)
    sizes = chunks.filter("k = 'hot'").groupBy("_chunk").count().collect()
    assert len(sizes) > 5 and max(r["count"] for r in sizes) < 200
    assert ordering._hot_cuts(table, ["k"], ["a", "b"], 10_000) is None


def test_many_cuts_use_both_search_levels(spark):
    df = spark.range(4000).select(F.lit("one").alias("k"), F.col("id").alias("b"))
    got = ordering.with_index(df, ["k"], ["b"], "i", chunk_rows=10)
    assert got.filter("i != b + 1").count() == 0
    assert got.count() == 4000


@pytest.mark.parametrize("offset, limit", [(0, 10), (95, 20), (1790, 50), (5000, 10), (3, 0)])
def test_rows_between_deep_path(table, rows, offset, limit):
    ordered = sorted(r[2] for r in rows)
    deep = ordering.rows_between(table, ["b"], offset, limit, top_rows=-1)
    shallow = ordering.rows_between(table, ["b"], offset, limit)
    assert sorted(r["b"] for r in deep.collect()) == ordered[offset : offset + limit]
    assert sorted(r["b"] for r in shallow.collect()) == ordered[offset : offset + limit]
